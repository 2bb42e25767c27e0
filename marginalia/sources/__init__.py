"""Sources: note pages, harvested records, cached lines, attachments."""
