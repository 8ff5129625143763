"""Sequential algorithms on one instance; frames of many instances run them in parallel."""
