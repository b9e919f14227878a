"""Tables that change together: immutable bucket folders under a manifest, of which each version is committed once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import staged

#: Digits of the digest that deals keys into buckets and leaves, so that other engines can tell them too.
_DIGITS = 8
FANOUT = 16


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def slot(key: Column, n: int) -> Column:
    """The bucket or leaf of a key, of ``n``: the first digits of its MD5 modulo ``n``."""
    last = next((d for d in range(1, _DIGITS) if 16**d % n == 0), _DIGITS)  # the digits that the remainder depends on
    return (F.conv(F.substring(F.md5(key.cast("string")), _DIGITS + 1 - last, last), 16, 10).cast("long") % n).cast("int")


def _row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def hash_tree(rows: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """``(level, node, n_rows, h0, h1, h2, h3)``: counts and sums of row hashes over slots of keys, down to ``FANOUT ** depth``
    leaves; a node is the sum of its ``FANOUT`` children, level 0 the whole table.

    Sums do not mind the order of rows and are made before the shuffle. Null keys lie in slot 0.
    """
    digest = _row_hash(rows.columns)
    leaf = F.coalesce(slot(F.col(key), FANOUT**depth), F.lit(0))
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(4)]
    leaves = rows.select(leaf.alias("leaf"), *parts).groupBy("leaf").agg(F.count("*").alias("n_rows"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    wide = leaves.select("*", levels.alias("level")).withColumn("node", F.floor(F.col("leaf") / F.pow(F.lit(FANOUT), depth - F.col("level"))).cast("int"))
    return wide.groupBy("level", "node").agg(F.sum("n_rows").alias("n_rows"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])


def tree_differences(left: DataFrame, right: DataFrame, depth: int = 2) -> DataFrame:
    """Leaves in which two trees differ, found from the root down: only children of nodes that differ are compared."""
    told = ["n_rows", "h0", "h1", "h2", "h3"]
    a, b = (t.select("level", "node", F.struct(*told).alias(side)) for t, side in ((left, "a"), (right, "b")))
    above = None
    for level in range(depth + 1):
        one, two = (t.filter(F.col("level") == level).drop("level") for t in (a, b))
        if above is not None:
            child = F.floor(F.col("node") / FANOUT).cast("int") == F.col("parent")
            one, two = (t.join(above, child, "left_semi") for t in (one, two))
        differ = staged(one.join(two, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node"))
        above = differ.withColumnRenamed("node", "parent")
        if differ.isEmpty():
            break
    return differ if level == depth else differ.filter("false")


def differing_rows(left: DataFrame, right: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """``(key, change)`` of two tables with unique keys: ``added``, ``removed`` or ``changed``; only rows in leaves that
    differ are read beyond their trees."""
    leaves = tree_differences(hash_tree(left, key, depth), hash_tree(right, key, depth), depth)
    def near(t: DataFrame, as_: str, hashed: str) -> DataFrame:
        own = t.select(F.col(key).alias(as_), _row_hash(t.columns).alias(hashed))
        return own.join(leaves, F.coalesce(slot(F.col(as_), FANOUT**depth), F.lit(0)) == F.col("node"), "left_semi")

    both = near(left, "left_key", "was").join(near(right, "right_key", "now"), F.col("left_key").eqNullSafe(F.col("right_key")), "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.filter("not (was <=> now)").select(F.coalesce("left_key", "right_key").alias(key), change.alias("change"))


class Snapshots:
    """Tables by versions: version v names, for each table, the folder of each bucket; folders never change.

    A commit writes a manifest under the next number, which exists at once and whole or not at all, so a reader that holds
    a version sees all its tables as they were together, whatever is written meanwhile. Two writers from one version
    cannot both commit. The driver handles names of folders, as many as there are buckets; rows stay in Spark.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        folder = self._hadoop.Path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds: ``tables`` and ``imports``; version 0 holds nothing."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "imports": {}, "note": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{version:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, base: dict, tables: dict[str, dict], imports: dict | None = None, note: dict | None = None) -> dict:
        """The version after ``base`` with some of its tables replaced; ``Conflict`` if there is one already."""
        new = {"version": base["version"] + 1, "tables": {**base["tables"], **tables}, "imports": {**base["imports"], **(imports or {})}, "note": note or {}}
        draft = self._hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        final = self._hadoop.Path(f"{self.path}/manifests/{new['version']:020d}.json")
        self._fs.mkdirs(final.getParent())
        try:  # a rename that does not replace: one of two writers fails
            context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
            context.rename(draft, final, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {new['version']} exists") from None
            raise
        return new

    def read(self, manifest: dict, table: str, buckets: list[int] | None = None, lenient: bool = False) -> DataFrame | None:
        """A table's rows in a version, of some buckets if asked for; None if there is no such table.

        ``lenient`` leaves out files that cannot be read, for checks that tell what is missing.
        """
        entry = manifest["tables"].get(table)
        if entry is None:
            return None
        folders = sorted({f"{self.path}/data/{f}/_bucket={b}" for b, f in entry["folders"].items() if buckets is None or int(b) in buckets})
        reader = self.spark.read.schema(entry["schema"])
        if lenient:
            reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], entry["schema"])

    def replaced(self, manifest: dict, table: str, key: str, rows: DataFrame, gone: DataFrame | None = None) -> dict:
        """The entry of ``table`` with all rows of the keys of ``rows`` and ``gone`` replaced by ``rows``.

        Only buckets that hold such a key are read and written; Spark splits large ones over tasks. Null keys are left out.
        """
        entry = manifest["tables"].get(table)
        if entry is None:
            return self.whole(table, key, rows)
        rows = staged(rows.filter(F.col(key).isNotNull()).withColumn("_bucket", slot(F.col(key), self.buckets)))
        changed = rows.select(key)
        if gone is not None:
            changed = changed.union(gone.select(key).filter(F.col(key).isNotNull()))
        changed = staged(changed.distinct())
        touched = sorted(r[0] for r in changed.select(slot(F.col(key), self.buckets)).distinct().collect())  # as many as buckets
        if not touched:
            return entry
        old = self.read(manifest, table, touched)
        kept = old.join(changed, key, "left_anti").select(*[c for c in rows.columns if c != "_bucket"])
        rows = rows.unionByName(kept.withColumn("_bucket", slot(F.col(key), self.buckets)))
        folders = {b: f for b, f in entry["folders"].items() if int(b) not in touched}
        return {**entry, "folders": folders | self._written(table, rows)}

    def whole(self, table: str, key: str, rows: DataFrame) -> dict:
        """The entry of ``table`` with ``rows`` and nothing else, whatever it held before; rows are computed and shuffled
        once, and older ones are not read. Null keys are left out."""
        own = rows.filter(F.col(key).isNotNull()).withColumn("_bucket", slot(F.col(key), self.buckets))
        return {"schema": _ddl(rows), "key": key, "folders": self._written(table, own)}

    def _written(self, table: str, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket that ``rows`` with a ``_bucket`` have a row in."""
        folder = f"{table}-{uuid.uuid4().hex}"
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data/{folder}"))]
        return dict.fromkeys(sorted(n.removeprefix("_bucket=") for n in names if n.startswith("_bucket=")), folder)

    def import_once(self, fingerprint: str, tables: dict[str, tuple[str, DataFrame]]) -> dict:
        """Load ``{table: (key, rows)}`` into an empty store, or tell that the same load was made: its counts.

        The ledger of fingerprints is in the manifest, so a load that fails half-way has left no mark. A store that holds
        anything else is refused with ``ValueError``.
        """
        base = self.manifest()
        if fingerprint in base["imports"]:
            return {**base["imports"][fingerprint], "already_imported": True}
        if base["tables"]:
            raise ValueError("not empty")
        made = {name: self.replaced(base, name, key, rows) for name, (key, rows) in tables.items()}
        counts = {name: self.read({"tables": made}, name).count() for name in made}
        self.commit(base, made, imports={fingerprint: counts}, note={"import": fingerprint})
        return {**counts, "already_imported": False}

    def sealed(self, manifest: dict) -> dict:
        """Entries with the tree of each table, by which ``verify`` tells later whether its rows are still these."""
        out = {}
        for name, entry in manifest["tables"].items():
            folder = f"{name}-tree-{uuid.uuid4().hex}"
            hash_tree(self.read(manifest, name), entry["key"]).write.parquet(f"{self.path}/data/{folder}")
            out[name] = {**entry, "tree": folder}
        return out

    def verify(self, manifest: dict) -> dict[str, list[int]]:
        """Buckets of sealed tables whose rows are not those that were sealed, by descending the trees; empty if all are."""
        if FANOUT**2 % self.buckets:
            raise ValueError("buckets must divide the leaves")
        out = {}
        for name, entry in manifest["tables"].items():
            if "tree" in entry:
                now = hash_tree(self.read(manifest, name, lenient=True), entry["key"])
                leaves = tree_differences(self.spark.read.parquet(f"{self.path}/data/{entry['tree']}"), now)
                bad = sorted(r[0] for r in leaves.select((F.col("node") % self.buckets).cast("int")).distinct().collect())
                if bad:
                    out[name] = bad
        return out

    def quarantine(self, manifest: dict, bad: dict[str, list[int]]) -> dict:
        """A version without the corrupt buckets: each as the last version before it had it elsewhere, or else left out.

        What was taken away is named in the note (``quarantined``), with those that nothing could replace (``lost``).
        """
        tables, taken, lost = {}, {}, {}
        for name, buckets in bad.items():
            entry = manifest["tables"][name]
            folders = dict(entry["folders"])
            for b in map(str, buckets):
                corrupt = folders.pop(b, None)
                taken.setdefault(name, {})[b] = corrupt
                older = next((f for v in range(manifest["version"] - 1, 0, -1) if (f := self.manifest(v)["tables"].get(name, {}).get("folders", {}).get(b)) and f != corrupt), None)
                if older:
                    folders[b] = older
                else:
                    lost.setdefault(name, []).append(int(b))
            tables[name] = {k: v for k, v in {**entry, "folders": folders}.items() if k != "tree"}
        return self.commit(manifest, tables, note={"quarantined": taken, "lost": lost})


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
