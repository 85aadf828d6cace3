"""Reading and writing tensors, state dicts and checkpoints through Spark."""
