from .text import projected_text, write_matrix, write_projected
