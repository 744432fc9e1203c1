"""Column expressions and the token counters and embedding providers behind them."""
