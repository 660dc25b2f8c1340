"""pixelloom: medical image files as Spark tables, from bytes to displayable pixels."""
