from tallyworks.sources.files import read_csv, read_lines, read_tab_text
from tallyworks.sources.listing import file_tree, list_tree, table_files
from tallyworks.sources.records import read_records

__all__ = ["file_tree", "list_tree", "read_csv", "read_lines", "read_records", "read_tab_text", "table_files"]
