"""The viewer's interaction log as keyed state."""
