"""Sources: tables, captures, certificates, fixtures."""
