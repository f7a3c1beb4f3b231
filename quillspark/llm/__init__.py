"""Training-data operators over documents and web pages; nothing outside imports them."""
