"""Writers for the derived sections."""
