"""Keys, batches, settings and plans held in memory."""
