"""Every operator as a query over the test tables, next to the SQL that checks it."""

from . import fits, rows, statistics, tables
from .register import QUERIES, SQL
