"""DataFrame operators over key-value tables, command logs and vectors."""
