"""Reading documents: repair of bytes, XML trees, fetching."""
