from .tables import rows_from_arrays, rows_from_columns, rows_from_vectors, scan_rows
from .text import convert_matrix, read_coo, read_dense, read_vector_text
from .trials import read_trials
