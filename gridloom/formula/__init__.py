"""The spreadsheet formula language: parser, values, interpreter, and compiler to Spark columns."""
