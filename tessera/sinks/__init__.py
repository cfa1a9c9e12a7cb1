"""Writers in the established file formats."""
