"""Row-local Column functions; every one also works on a streaming DataFrame."""
