"""Training-data operators: ten operators over documents, embeddings and conversations. Nothing else in the library imports this subpackage."""
