"""Products that leave and enter: bundles of files with a manifest, mappings as CSV, and repositories of a host that lists them by pages."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

MANIFEST = "manifest.json"


def pack(files: Mapping[str, bytes]) -> bytes:
    """A bundle of a publication's files (small ones; relations stay where they are): a ZIP with digests and sizes in its manifest, the same bytes for the same files."""
    out = io.BytesIO()
    manifest = {"version": 1, "files": {name: {"sha256": hashlib.sha256(body).hexdigest(), "size": len(body)} for name, body in sorted(files.items())}}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in [(MANIFEST, json.dumps(manifest, sort_keys=True).encode()), *sorted(files.items())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def unpack(bundle: bytes) -> dict[str, bytes]:
    """The files of a bundle; names that leave it, files that aren't in the manifest or differ from it, and missing ones are refused."""
    try:
        return _unpacked(bundle)
    except (zipfile.BadZipFile, KeyError) as e:
        raise ValueError("the bundle can't be read") from e


def _unpacked(bundle: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(bundle)) as z:
        declared = json.loads(z.read(MANIFEST))["files"]
        names = [i.filename for i in z.infolist() if i.filename != MANIFEST]
        if sorted(names) != sorted(declared) or any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") for n in names):
            raise ValueError("the bundle's files are not those of its manifest")
        out = {}
        for name in names:
            if z.getinfo(name).file_size != declared[name]["size"] or hashlib.sha256(body := z.read(name)).hexdigest() != declared[name]["sha256"]:
                raise ValueError(f"{name} differs from the manifest")
            out[name] = body
        return out


def export_mapping(value_sources: DataFrame, path: str) -> None:
    """Target columns with their sources as CSV in total order, as people who read mappings want them."""
    order = ["target", "target_column", "terminal_kind", "source_relation", "source_column"]
    rows = value_sources.select(*order, "n_branches", "complete", "mapping_kind")
    rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).write.option("header", True).csv(path)


class PagedRepositories(DataSource):
    """Repositories of a host: ``fetch(page)`` gives (items, last page?), items being (repo_id, project_id, clone_url); pages are read one behind the other."""

    fetch: Callable[[int], tuple[list[tuple[str, str, str]], bool]]

    @classmethod
    def name(cls) -> str:
        return "paged_repositories"

    def schema(self) -> str:
        return "repo_id string, project_id string, clone_url string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options.get("most_pages", 10_000)))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, most: int):
        self.fetch, self.most = fetch, most

    def read(self, partition) -> Iterator[tuple]:
        for page in range(self.most):
            items, last = self.fetch(page)
            yield from items
            if last:
                return
        raise ValueError(f"more than {self.most} pages")


def repositories(spark: SparkSession, fetch: Callable[[int], tuple[list[tuple[str, str, str]], bool]], most_pages: int = 10_000) -> DataFrame:
    """The repositories that ``fetch`` lists, each once; more pages than ``most_pages`` are an error, not a cut."""
    source = type("Repositories", (PagedRepositories,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(source)
    return spark.read.format("paged_repositories").option("most_pages", most_pages).load().dropDuplicates(["repo_id"])
