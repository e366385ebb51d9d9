"""Size bounds that pick a plan.  Everything on the driver or in a task closure
has model size (columns x components); these constants say how large that may be.
"""

import numpy as np

# Up to these sizes expressions written out in SQL are as fast as Arrow blocks
# (measured on 400,000 rows); beyond, generated code grows faster than the work.
MAX_WIDE_AGGREGATES = 20
MAX_WIDE_PRODUCTS = 16
MAX_WIDE_COLUMNS = 16
# up to this many columns one scatter-matrix pass replaces a pass per EM round
MAX_GRAM_COLUMNS = 512
# model arrays that are shipped to every task
MAX_CLOSURE_BYTES = 1 << 30
# lookup tables that are broadcast
MAX_BROADCAST_BYTES = 64 << 20
# the same for file splits, counted in rows
MAX_BROADCAST_ROWS = 200_000
# cells of one numpy work block inside a task
BLOCK_CELLS = 1 << 20


def wake_blas() -> None:
    """Lets a plain product start the threads of numpy's library on the driver.

    A session forks the driver; a factorisation of 100 rows and more that starts the
    threads afterwards can wait for ever, while after a product it never did (seen with
    OpenBLAS).  Tasks run with one thread and need nothing.
    """
    block = np.ones((512, 512))
    block @ block


def check_bytes(what: str, n_doubles: int, limit: int = MAX_CLOSURE_BYTES) -> None:
    if 8 * n_doubles > limit:
        raise ValueError(f"{what}: {8 * n_doubles:,} bytes exceed the bound of {limit:,}")


def gram_fits(d: int) -> bool:
    return d <= MAX_GRAM_COLUMNS


def wide_gram_fits(d: int) -> bool:
    return d * (d + 1) // 2 + 2 * d + 1 <= MAX_WIDE_AGGREGATES
