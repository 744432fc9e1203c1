"""Where files come from: directory scans, ignore rules and contents."""
