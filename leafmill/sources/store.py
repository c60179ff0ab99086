"""A document database on Parquet: an append-only log of revisions, written in batches that one rename commits.

Layout: revs/batch=N holds the revisions of batch N, and revs/base=N, after a compaction, what is left of all batches up to N; kv holds local
documents, system those of the system; attachments holds blobs in chunks. One writer at a time, as many readers as wanted; a reader's snapshot is the
number of the last batch that it takes into account. A base counts from the rename that makes it visible, and hides the batches up to N.

A row with an hlc is an entry of the changes feed, and stands for its document's winner at that time. Where a write leaves an older revision
the winner, its row is entered again; such rows (`again`) are in the feed, but are no revisions of their own.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import revs as R
from ..functions.hlc import Clock, Stamp
from ..functions.values import make_record
from ..operators import revtree
from ..operators.find import Page, find, find_page, fold_docs, get_many
from ..operators.joins import by_key
from ..plans.conditions import QueryError
from ..plans.query import compile_query
from .attachments import Attachments
from .files import Folder
from .keyvalue import KeyValue

#: The folder of the system documents; no database can have this name.
SYSTEM = "_system"
NAME = re.compile(r"_?[a-z0-9_-]{1,63}")
_STAMP = T.StructType([T.StructField("wall", T.LongType()), T.StructField("logical", T.LongType())])
_KINDS = {"doc_id": T.StringType(), "rev": T.StringType(), "parent": T.StringType(), "deleted": T.BooleanType(), "hlc": _STAMP, "body": T.StringType(), "again": T.BooleanType()}
#: Up to so many documents are looked up by a filter on their ids.
FEW_IDS = 500
_GIVEN = "doc_id string, rev string, parent string, deleted boolean, body string"
REVS = T.StructType([T.StructField(n, k) for n, k in _KINDS.items()])


def check_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise QueryError("invalid_db_name", name)
    return name


@dataclass
class Databases:
    """The databases below one folder, and the system documents that they share: global, never replicated, in a folder of their own."""

    spark: SparkSession
    root: str

    def create(self, name: str) -> Store:
        folder = Folder(self.spark, self.root)
        if check_name(name) == SYSTEM:
            raise QueryError("invalid_db_name", name)
        if folder.exists(name):
            raise QueryError("already_exists", name)
        folder.make(name, "revs")
        return self.open(name)

    def open(self, name: str) -> Store:
        if check_name(name) == SYSTEM or not Folder(self.spark, self.root).exists(name):
            raise QueryError("not_found", name)
        return Store(self.spark, f"{self.root.rstrip('/')}/{name}")

    def delete(self, name: str) -> None:
        if check_name(name) == SYSTEM:
            raise QueryError("not_found", name)
        Folder(self.spark, self.root).delete(name)

    def names(self) -> list[str]:
        return [n for n in Folder(self.spark, self.root).names() if n != SYSTEM]

    @property
    def system(self) -> KeyValue:
        """System documents: put, get, delete, fold by prefix, and node_id, which is made once for all databases."""
        return KeyValue(self.spark, f"{self.root.rstrip('/')}/{SYSTEM}")


class Store:
    def __init__(self, spark: SparkSession, root: str, clock: Clock | None = None):
        self.spark, self.folder, self.clock = spark, Folder(spark, root), clock or Clock()
        self.local = KeyValue(spark, self.folder.path("kv"))
        self.system = KeyValue(spark, self.folder.path("system"))
        self.attachments = Attachments(spark, self.folder.path("attachments"))
        self._met = False

    # --- reading ---

    def _parts(self) -> tuple[int, list[int]]:
        """The number of the base (0 without one) and those of the batches after it."""
        names = self.folder.names("revs")
        base = max((int(n[5:]) for n in names if n.startswith("base=")), default=0)
        return base, sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) > base)

    def snapshot(self) -> int:
        """The last committed batch; 0 if there is none."""
        base, batches = self._parts()
        return batches[-1] if batches else base

    def _rows(self, as_of: int | None = None) -> DataFrame:
        base, batches = self._parts()
        if as_of is not None and as_of < base:
            raise QueryError("snapshot_expired", as_of)
        found = [self.folder.path("revs", f"batch={n:012d}") for n in batches if as_of is None or n <= as_of]
        found += [self.folder.path("revs", f"base={base:012d}")] if base else []
        return self.spark.read.schema(REVS).parquet(*found) if found else self.spark.createDataFrame([], REVS)

    def revisions(self, as_of: int | None = None) -> DataFrame:
        """Every revision up to a snapshot, once: doc_id, rev, parent, deleted, hlc, body (JSON text; null where only the history is known)."""
        return self._rows(as_of).filter(~F.coalesce("again", F.lit(False))).drop("again")

    def log(self, as_of: int | None = None) -> DataFrame:
        """The log that the changes feed reads, with a VARIANT body; each row stands for its document's winner at that time."""
        rows = self._rows(as_of).filter("hlc is not null")
        return rows.select(F.col("doc_id").alias("id"), "rev", "deleted", "hlc", F.try_parse_json("body").alias("body"))

    def _of(self, ids: DataFrame, column: str) -> DataFrame:
        """Revisions of the documents in ids. A few ids reach the scan as a filter; more are a semi join."""
        few = [r[0] for r in ids.select(column).distinct().limit(FEW_IDS + 1).collect()]
        if len(few) <= FEW_IDS:
            return self.revisions().filter(F.col("doc_id").isin(*few)) if few else self.revisions().filter(F.lit(False))
        return self.revisions().join(by_key(ids.select(F.col(column).alias("doc_id")).distinct()), "doc_id", "left_semi")

    def entities(self, as_of: int | None = None) -> DataFrame:
        """Each document's winner: id, rev, deleted, json."""
        return self._winners(self.revisions(as_of))

    @staticmethod
    def _winners(rows: DataFrame) -> DataFrame:
        return revtree.winners(rows, "body").select(F.col("doc_id").alias("id"), "rev", "deleted", F.col("body").alias("json"))

    def docs(self, as_of: int | None = None) -> DataFrame:
        """Documents as they are: id, rev, body (VARIANT); no tombstones."""
        return self.entities(as_of).filter(~F.col("deleted")).select("id", "rev", F.parse_json(F.coalesce("json", F.lit("{}"))).alias("body"))

    def get(self, doc_id: str, conflicts: bool = False, rev: str | None = None, as_of: int | None = None) -> dict | None:
        """id, rev, deleted and body of one document, or of one of its revisions; None if there is none."""
        own = self.revisions(as_of).filter(F.col("doc_id") == doc_id)
        if rev is not None:
            row = own.filter(F.col("rev") == rev).orderBy(F.col("body").isNull()).first()
            return row and {"id": doc_id, "rev": row.rev, "deleted": row.deleted, "body": row.body}
        won = revtree.winners(own).first()
        if won is None or won.deleted:
            return None
        out = {"id": doc_id, "rev": won.rev, "deleted": False, "body": own.filter(F.col("rev") == won.rev).agg(F.max("body")).first()[0]}
        return out | {"conflicts": self.conflicts(doc_id, as_of)} if conflicts else out

    def get_many(self, ids: list[str], as_of: int | None = None) -> DataFrame:
        """In the order asked for: pos, id, found, rev, body."""
        own = self.revisions(as_of).filter(F.col("doc_id").isin(*ids)) if ids else self.revisions(as_of).filter(F.lit(False))
        docs = self._winners(own).filter(~F.col("deleted")).select("id", "rev", F.parse_json(F.coalesce("json", F.lit("{}"))).alias("body"))
        return get_many(docs, ids, "id").select("pos", "id", "found", "rev", "body")

    def find(self, spec: dict, as_of: int | None = None) -> DataFrame:
        return find(self.docs(as_of), spec, "id", "body")

    def find_page(self, spec: dict, size: int = 1000, token: str | None = None, eventual: bool = False) -> Page:
        """A page; its token holds for the state of the first page only, unless eventual."""
        return find_page(self.docs(), compile_query(spec) and spec, size, token, "id", "body", "" if eventual else str(self.snapshot()))

    def fold(self, fun, start, with_deleted: bool = False, combine=None):
        """fun(row, accumulator) over each document's winner (id, rev, deleted, json). Without combine all of them pass through the driver; fold_docs says what it must do."""
        rows = self.entities()
        return fold_docs(rows, fun, start, None if with_deleted else "deleted", combine)

    def conflicts(self, doc_id: str, as_of: int | None = None) -> list[str]:
        own = self.revisions(as_of).filter(F.col("doc_id") == doc_id)
        return sorted((r.rev for r in revtree.conflicts(own).collect()), key=R.parse_rev, reverse=True)

    def info(self) -> dict:
        all_docs = self.entities().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("deleted").cast("long")), F.lit(0)).alias("gone")).first()
        return {"docs": all_docs.n - all_docs.gone, "deleted": all_docs.gone, "bytes": self.folder.size("revs"), "attachment_bytes": self.folder.size("attachments"), "batch": self.snapshot()}

    # --- writing ---

    def _stamped(self) -> Column:
        """Stamps of a batch's rows: the wall moves on with the partition, logical is the place in it. No row waits for another."""
        if not self._met:  # a clock that is new to this store starts behind its last entry
            top = self._rows().agg(F.max("hlc").alias("m")).first().m
            if top is not None:
                self.clock.after(Stamp(top.wall, top.logical))
            self._met = True
        now, row = self.clock.now(), F.monotonically_increasing_id()
        wall = now.wall + (now.logical > 0)
        return F.struct((F.lit(wall) + F.shiftright(row, 33)).cast("long").alias("wall"), row.bitwiseAND(F.lit((1 << 33) - 1)).cast("long").alias("logical"))

    def _write(self, rows: DataFrame, name: str) -> None:
        """Rows as a folder below revs, made visible by one rename; sorted by document within a file, which lets a look-up pass over row groups."""
        staged = f"staging-{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in REVS.fields)).write.parquet(self.folder.path(staged))
        self.folder.rename((staged,), ("revs", name))

    def _commit(self, rows: DataFrame) -> int:
        """Writes rows (doc_id, rev, parent, deleted, body, current, again) as one batch. Rows that are not current are history only; one row of a document is current at most."""
        number = self.snapshot() + 1
        stamped = rows.sortWithinPartitions("doc_id").withColumn("hlc", F.when(F.col("current"), self._stamped()))
        self._write(stamped, f"batch={number:012d}")
        top = self.spark.read.schema(REVS).parquet(self.folder.path("revs", f"batch={number:012d}")).agg(F.max("hlc").alias("m")).first().m
        if top is not None:
            self.clock.after(Stamp(top.wall, top.logical))
        return number

    def put_docs(self, docs: DataFrame) -> DataFrame:
        """docs (id, body JSON text, and as wanted rev, deleted) written if they fit; the result has a row for each: id, rev, ok, error.

        A document is new, or names the winner's revision in rev; anything else is a "conflict". A deleted document may be
        made again without a rev. Of rows with one id the first by rev and body counts and others conflict, equal ones too. Bodies that are no JSON object
        are "invalid_doc". Names that start with "_" are dropped from bodies.
        """
        have = set(docs.columns)
        rows = docs.select(
            F.coalesce(F.col("id").cast("string"), F.md5(F.expr("uuid()"))).alias("id"), F.try_parse_json("body").alias("v"),
            (F.col("rev") if "rev" in have else F.lit(None)).cast("string").alias("given"), (F.coalesce("deleted", F.lit(False)) if "deleted" in have else F.lit(False)).alias("gone"),
        )
        fields = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: ~k.startswith("_"))
        rows = rows.withColumn("body", F.to_json(fields)).drop("v").withColumn("place", F.monotonically_increasing_id()).checkpoint()
        first = rows.groupBy("id").agg(F.min(F.struct(F.coalesce("given", F.lit("")).alias("g"), F.coalesce("body", F.lit("")).alias("b"), F.col("place").alias("p"))).getField("p").alias("first"))
        now = self._winners(self._of(rows, "id")).select("id", F.col("rev").alias("now"), F.col("deleted").alias("was_gone"))
        judged = rows.join(by_key(first), "id").join(by_key(now), "id", "left")
        chosen = F.col("place") == F.col("first")
        fits = F.when(F.col("now").isNull(), F.col("given").isNull() & ~F.col("gone")).when(F.col("given").isNull(), F.col("was_gone")).otherwise(F.col("given") == F.col("now"))
        error = F.when(F.col("body").isNull() & ~F.col("gone"), "invalid_doc").when(F.col("now").isNull() & F.col("gone"), "not_found").when(~chosen | ~F.coalesce(fits, F.lit(False)), "conflict")
        judged = judged.withColumn("error", error).withColumn("parent", F.col("now")).withColumn("new", R.rev_of(F.col("body"), F.col("now"), F.col("gone"))).checkpoint()
        good = judged.filter("error is null")
        self._commit(good.select(F.col("id").alias("doc_id"), F.col("new").alias("rev"), "parent", F.col("gone").alias("deleted"), "body", F.lit(True).alias("current"), F.lit(False).alias("again")))
        ok = F.col("error").isNull()
        return judged.select("id", F.when(ok, F.col("new")).alias("rev"), ok.alias("ok"), "error")

    def put(self, doc: dict) -> str:
        """One document as a dict with `id`, and `_rev` or `_deleted` as wanted; its new revision. A batch of one: batches of many are the fast way."""
        r = make_record(doc)
        row = self.put_docs(self.spark.createDataFrame([(r["id"], r["body"], r["rev"], r["deleted"])], "id string, body string, rev string, deleted boolean")).first()
        if not row.ok:
            raise QueryError(row.error, r["id"])
        return row.rev

    def delete(self, doc_id: str, rev: str | None = None) -> str:
        if rev is None:
            now = self.get(doc_id)
            if now is None:
                raise QueryError("not_found", doc_id)
            rev = now["rev"]
        return self.put({"id": doc_id, "_rev": rev, "_deleted": True})

    def put_revs(self, rows: DataFrame) -> int:
        """Revisions with their history, as they are: doc_id, rev, parent, deleted, body. What the store has is passed over; the batch's number.

        The feed gets each document's winner after the write, be it new or not, and nothing of the history below.
        """
        new = rows.groupBy("doc_id", "rev").agg(F.max("parent").alias("parent"), F.max("deleted").alias("deleted"), F.max("body").alias("body")).checkpoint()
        old = self._of(new, "doc_id").select("doc_id", "rev", "parent", "deleted", "body")
        new = new.join(by_key(old.select("doc_id", "rev")), ["doc_id", "rev"], "left_anti").withColumn("new", F.lit(True))
        # documents that only bring what the store has are no change
        touched = new.select("doc_id").distinct()
        tree = new.unionByName(old.join(by_key(touched), "doc_id", "left_semi").withColumn("new", F.lit(False))).checkpoint()
        won = revtree.winners(tree).select("doc_id", F.col("rev").alias("won"))
        current = F.col("rev") == F.col("won")
        entered = tree.join(by_key(won), "doc_id").filter(F.col("new") | current)
        return self._commit(entered.select("doc_id", "rev", "parent", "deleted", "body", current.alias("current"), (~F.col("new")).alias("again")))

    def put_rev(self, doc_id: str, body: str, history: list[str], deleted: bool = False) -> None:
        """One revision with an explicit history, newest first."""
        rows = [(doc_id, r, history[i + 1] if i + 1 < len(history) else None, deleted and i == 0, body if i == 0 else None) for i, r in enumerate(history)]
        for r in history:
            R.parse_rev(r)
        self.put_revs(self.spark.createDataFrame(rows, _GIVEN))

    def resolve(self, doc_id: str, rev: str, choose: str | None = None, merged: str | None = None) -> str:
        """Ends the conflicts of a document whose winner is rev: by choosing a leaf, or with a merged body. The revision that then wins."""
        now = self.get(doc_id, conflicts=True)
        if now is None:
            raise QueryError("not_found", doc_id)
        if not now["conflicts"]:
            raise QueryError("no_conflicts", doc_id)
        if rev != now["rev"]:
            raise QueryError("conflict", doc_id)
        if choose is not None and choose not in (rev, *now["conflicts"]):
            raise QueryError("invalid_rev", choose)
        body = merged if merged is not None else self.get(doc_id, rev=choose)["body"]
        out, rows = rev, []
        for loser in now["conflicts"]:
            rows.append((doc_id, R.make_rev(R.parse_rev(loser)[0] + 1, R.parse_rev(R.next_rev(None, loser, True))[1]), loser, True, None))
        if choose != rev:  # a child of the winner, far enough above the tombstones
            out = R.next_rev(body, rev)
            rows.append((doc_id, out, rev, False, body))
        top = max(R.parse_rev(r[1]) for r in rows if r[3])
        while R.parse_rev(out) < top:
            parent, out = out, R.next_rev(body, out)
            rows.append((doc_id, out, parent, False, body))
        self.put_revs(self.spark.createDataFrame(rows, _GIVEN))
        return out

    def compact(self, depth: int = 1000) -> int:
        """Keeps the last depth revisions of each branch and the last entry of each document in the feed, in one base. The number of the last batch in it.

        Snapshots before it end. Readers see the batches or the base, never both, and streams pass over what they delivered already.
        """
        rows = self._rows()
        one = rows.groupBy("doc_id", "rev").agg(F.max("parent").alias("parent"), F.max("deleted").alias("deleted"), F.max("hlc").alias("hlc"), F.max("body").alias("body"))
        kept = revtree.prune(one, depth).checkpoint()
        leaf = revtree.leaves(kept).select("doc_id", "rev", F.lit(True).alias("leaf"))
        last = kept.groupBy("doc_id").agg(F.max("hlc").alias("last"))
        slim = kept.join(by_key(leaf), ["doc_id", "rev"], "left").join(by_key(last), "doc_id").select("doc_id", "rev", "parent", "deleted", F.when(F.col("hlc") == F.col("last"), F.col("hlc")).alias("hlc"), F.when(F.col("leaf"), F.col("body")).alias("body"), F.lit(False).alias("again"))
        number, old = self.snapshot(), self.folder.names("revs")
        name = f"base={number:012d}"
        if not number or name in old:  # nothing came in since the last one
            return number
        self._write(slim.sortWithinPartitions("doc_id"), name)
        for n in old:
            self.folder.delete("revs", n)
        return number
