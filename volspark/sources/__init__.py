"""Where volumes come from: files and tables."""
