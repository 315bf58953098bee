"""The same transforms over streams: feeds, keyed state, joins and progress."""
