"""gridloom: spreadsheet- and document-shaped analytics on Spark."""
