"""One file of any size from distributed rows, in order.

Rows are written by partition, in ranges of their order, below a hidden folder beside the target; then the parts and the
texts between them become one file by the file system's own concatenation where it has one (blocks are only renamed
there), else by copying streams.  Either way the driver holds one buffer, and the target appears whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.files import Files


def write_document(spark: SparkSession, path: str, sections: list[str | tuple[DataFrame, list]], separator: str = ",") -> int:
    """Writes ``sections`` as one file at ``path``, over an older one, and returns its bytes.

    A section is a text or (rows, order): a DataFrame whose first column is text, and the columns to order it by; its rows
    are parted by a line end and ``separator``.  Null rows are left out; a table without rows adds nothing.  Runs its jobs when it is called.
    """
    files = Files(spark, path)
    folder, _, name = path.rstrip("/").rpartition("/")
    work = f"{folder or '.'}/.{name}-{uuid.uuid4().hex}"
    files.fs.mkdirs(files.path(work))
    try:
        parts, texts = [], 0

        def put(text: str) -> None:
            nonlocal texts
            parts.append(files.path(work, f"text-{texts}"))
            files.write(parts[-1], text.encode())
            texts += 1

        for no, section in enumerate(sections):
            if isinstance(section, str):
                put(section)
                continue
            rows, order = section
            value, first = rows.columns[0], F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
            ordered = rows.where(F.col(f"`{value}`").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
            # the separator stands before each row but a part's first, as the text source ends every row alike
            ordered.select(F.concat(F.when(first, "").otherwise(separator), F.col(f"`{value}`")).alias("value")).write.text(f"{work}/rows-{no}")
            found = [s.getPath() for s in files.fs.listStatus(files.path(work, f"rows-{no}")) if s.getLen() and s.getPath().getName().startswith("part-")]
            for i, p in enumerate(sorted(found, key=lambda p: p.getName())):
                if i:
                    put(separator)
                parts.append(p)
        whole = files.path(work, "whole")
        files.join(parts, whole)
        files.replace(whole, files.path(path))
        return files.fs.getFileStatus(files.path(path)).getLen()
    finally:
        files.fs.delete(files.path(work), True)
