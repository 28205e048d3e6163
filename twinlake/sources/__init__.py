"""Named sources: what to read, how, and which key it declares."""
