"""See the modules in this folder."""
