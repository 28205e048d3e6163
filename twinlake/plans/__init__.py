"""What a comparison needs to know before it runs, and what it reports afterwards."""
