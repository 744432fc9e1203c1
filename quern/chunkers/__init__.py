"""Table functions that split a file into chunks, by format."""
