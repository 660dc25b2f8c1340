"""Reading and writing medical image files."""

#: Of a batch, so many rows are Python objects at a time, and so many bytes are answered at once.
ROWS, RUN = 1 << 9, 1 << 26
