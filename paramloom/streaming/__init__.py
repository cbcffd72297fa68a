"""Message streams; the row-wise operators are those of the batch side."""
