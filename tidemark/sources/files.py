"""Small file operations on any Hadoop file system, from the driver.

Only names and short texts pass here: manifests, markers and moves of files
that Spark wrote.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        # Classes are looked up once: each dotted name costs the gateway several calls.
        self.path, self.context, self.text = hadoop.Path, hadoop.FileContext.getFileContext, jvm.org.apache.commons.io.IOUtils
        self.new_only = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        self.new_only[0] = getattr(hadoop, "Options$Rename").NONE
        self.systems: dict[str, tuple] = {}
        self.made: set[str] = set()

    def _system(self, path: str) -> tuple:
        """(file system, file context) of a path's scheme and authority."""
        root = "/".join(path.split("/")[:3]) if "://" in path else path.split("/")[0] if ":" in path.split("/")[0] else ""
        if root not in self.systems:
            p = self.path(path)
            fs = p.getFileSystem(self.conf)
            self.systems[root] = (fs, self.context(fs.getUri(), self.conf))
        return self.systems[root]

    def exists(self, path: str) -> bool:
        return self._system(path)[0].exists(self.path(path))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._system(folder)[0].listStatus(self.path(folder)))

    def files_below(self, folder: str) -> list[str]:
        """Paths of all files below a folder, relative to it, but for hidden ones."""
        if not self.exists(folder):
            return []
        out, todo = [], [""]
        while todo:
            at = todo.pop()
            for status in self._system(folder)[0].listStatus(self.path(f"{folder}/{at}" if at else folder)):
                name = status.getPath().getName()
                if status.isDirectory():
                    todo.append(f"{at}/{name}" if at else name)
                elif not name.startswith((".", "_")):
                    out.append(f"{at}/{name}" if at else name)
        return sorted(out)

    def read(self, path: str) -> str:
        stream = self._system(path)[0].open(self.path(path))
        try:
            return self.text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._system(path)[0].create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def folder(self, path: str) -> None:
        if path not in self.made:
            self._system(path)[0].mkdirs(self.path(path))
            self.made.add(path)

    def rename_new(self, source: str, target: str) -> bool:
        """Give a file or folder a name that must not exist yet; False if it does. Atomic where the file system's rename is."""
        try:
            self._system(source)[1].rename(self.path(source), self.path(target), self.new_only)
            return True
        except Exception:
            if self.exists(target):
                return False
            raise

    def move(self, source: str, target: str) -> bool:
        """Move a file or folder to a place that is not there; False if the source is gone (moved before).

        Where the target came into being meanwhile, a folder lands inside it: it is taken out file by file.
        """
        fs = self._system(source)[0]
        try:
            moved = fs.rename(self.path(source), self.path(target))
        except Exception:
            moved = False
        if not moved:
            if self.exists(source):
                raise OSError(f"cannot move {source} to {target}")
            return False
        inside = f"{target}/{source.rpartition('/')[2]}"
        if inside != target and self.exists(inside):
            for f in self.files_below(inside):
                fs.rename(self.path(f"{inside}/{f}"), self.path(f"{target}/{f}"))
            self.remove(inside)
        return True

    def remove(self, path: str) -> None:
        self._system(path)[0].delete(self.path(path), True)
