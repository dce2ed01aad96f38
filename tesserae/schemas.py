"""Logical schemas. Vectors and matrices are long tables with one row per stored entry; an absent row is a zero.

vector (i, v) or, if complex, (i, re, im); block vector (blk, i, v); coordinate matrix (i, j, v) or (i, j, re, im) with
unique (i, j); permutation (e, i), external to internal; points (dof, x); clusters and block clusters as trees of index
ranges [first, last]; edges (src, dst, w), symmetric and without loops; blocks with dense or low-rank payloads.
"""

from pyspark.sql import types as T


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


L, I, D, S, B, A = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.ArrayType(T.DoubleType())

VECTOR = _of(i=L, v=D)
COMPLEX_VECTOR = _of(i=L, re=D, im=D)
BLOCK_VECTOR = _of(blk=I, i=L, v=D)
COO = _of(i=L, j=L, v=D)
COMPLEX_COO = _of(i=L, j=L, re=D, im=D)
PERMUTATION = _of(e=L, i=L)
POINTS = _of(dof=L, x=A)
CLUSTERS = _of(cid=L, parent=L, lvl=I, first=L, last=L, is_leaf=B, is_domain=B, bbmin=A, bbmax=A)
BLOCK_CLUSTERS = _of(bid=L, parent=L, lvl=I, row_cid=L, col_cid=L, adm=B, is_leaf=B)
EDGES = _of(src=L, dst=L, w=D)
#: Dense payloads are column-major (`d`); low-rank ones are the column-major factors of a * b^H (`a`, `b`).
BLOCKS = _of(block_id=L, parent_id=L, bi=I, bj=I, lvl=I, row_first=L, row_last=L, col_first=L, col_last=L, kind=S, form=S, rank=I, d=A, a=A, b=A)
VERTICES = _of(vid=L, x=D, y=D, z=D)
TRIANGLES = _of(tid=L, v0=L, v1=L, v2=L)
SUPPORT = _of(dof=L, tid=L, local=I)
HISTORY = _of(it=I, res=D)
