"""The recurrence on streams: a sequence's state is kept by key, and splitting a stream anywhere gives the same answer."""
