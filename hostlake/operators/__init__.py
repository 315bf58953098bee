"""DataFrame to DataFrame building blocks: decoding, keyed writes, interval join."""
