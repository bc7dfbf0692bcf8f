"""Training-data operators: ten operators over text, pages and labels. Nothing else in the library imports this."""
