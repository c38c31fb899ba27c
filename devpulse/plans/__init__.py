"""Jobs that write: versioned rollups and incremental table maintenance."""
