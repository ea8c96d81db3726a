"""Set-at-a-time operators: blocks, chunks, indexes, retrieval, evaluation."""
