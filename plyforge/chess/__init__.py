"""Chess kernel: board, move generation, notations, and their Arrow-batched forms."""
