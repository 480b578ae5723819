"""Training-data operators for duplicates, leaks, packing and encodings; nothing else imports this package."""
