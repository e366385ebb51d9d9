from .blocks import dense_block, flat_sum, linear_rows, map_rows
from .budget import check_bytes
from .moments import GramMoments, RowMoments, SparseMoments, column_stats, moment_source
