"""functions of the sheet and document engine."""
