"""Column functions: text, prices, URLs, badge lists and JSON values."""
