"""Reading and writing of catalogue documents, files and test views."""
