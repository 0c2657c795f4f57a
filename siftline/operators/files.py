"""Files of any file system that Spark knows, changed as a whole."""

from __future__ import annotations

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import SparkSession


class Files:
    """The file system of a path, by the session's own configuration; paths may lie in any that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def write(self, path, text: bytes, overwrite: bool = False) -> None:
        out = self.fs.create(path, overwrite)
        try:
            out.write(bytearray(text))
        finally:
            out.close()

    def replace(self, source, target) -> None:
        """Renames over whatever is there, in one step."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(kinds.OVERWRITE.getClass(), 1)
        how[0] = kinds.OVERWRITE
        context.rename(self.fs.makeQualified(source), self.fs.makeQualified(target), how)

    def join(self, parts: list, target) -> None:
        """``parts`` (paths) one after the other as a new file; they are used up where the file system can concatenate."""
        sizes = [self.fs.getFileStatus(p).getLen() for p in parts]
        try:
            self.fs.create(target, False).close()
            if rest := [p for p, n in zip(parts, sizes) if n]:
                sources = self.jvm.java.lang.reflect.Array.newInstance(rest[0].getClass(), len(rest))
                for i, p in enumerate(rest):
                    sources[i] = p
                self.fs.concat(target, sources)
        except UnsupportedOperationException:
            out = self.fs.create(target, True)
            try:
                for p in parts:
                    source = self.fs.open(p)
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    finally:
                        source.close()
            finally:
                out.close()
        if (size := self.fs.getFileStatus(target).getLen()) != sum(sizes):
            raise OSError(f"{target.toString()} has {size} bytes instead of {sum(sizes)}")
