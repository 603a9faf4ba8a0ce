"""Where scripts, ledgers and published batches are stored and read from."""
