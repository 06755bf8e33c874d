"""Reading and writing tables, files and external stores."""
