"""Reading delimited files and workbook cells, writing exports."""
