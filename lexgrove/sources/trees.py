"""Strict ingest of tree documents: nested groups of words, one tree a document, walked once in the task.

The walk numbers what it enters and leaves, so a word lies inside a group exactly if its number
lies between the two of the group, and each word carries the groups it lies in: the closure is a matter of
exploding that list, without a join. What a tree must not have doesn't stop the job: it becomes
an error row, and its document gives no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of groups and of words run apart, each in preorder from 1; enter and leave run over both.
FIELDS = ("node", "parent", "kind", "tag", "role", "depth", "child_ord", "group_ord", "word_ord", "enter", "leave", "leftmost", "error")
SCHEMA = "node string, parent string, kind string, tag string, role string, depth long, child_ord long, group_ord long, word_ord long, enter long, leave long, leftmost string, error string, above array<string>"


ROWS = 4096  # nodes that go out together; a larger document goes out by itself


class TreeError(ValueError):
    """What makes a document no tree."""


class _Walk:
    """One document: rows of its nodes in preorder. Errors: no or several roots, an empty group, a repeated id, an unexpected tag, text that is not well formed."""

    def __init__(self, groups: frozenset[str], words: frozenset[str], wrappers: frozenset[str], ident: str) -> None:
        self.groups, self.words, self.wrappers, self.ident = groups, words, wrappers, ident
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.seen: set[str] = set()
        self.n = {"group": 0, "word": 0, "step": 0, "root": 0}

    def enter(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in self.wrappers:
            return
        kind = "group" if tag in self.groups else "word" if tag in self.words else None
        if kind is None:
            raise TreeError(f"unexpected tag {tag}")
        if self.open and self.open[-1]["kind"] == "word":
            raise TreeError(f"{tag} inside a word")
        self.n[kind] += 1
        self.n["step"] += 1
        key = attributes.get(self.ident) or f"{kind}{self.n[kind]}"
        if key in self.seen:
            raise TreeError(f"repeated id {key}")
        self.seen.add(key)
        up = self.open[-1] if self.open else None
        if up is None:
            self.n["root"] += 1
            if self.n["root"] > 1:
                raise TreeError("more than one root")
        else:
            up["children"] += 1
        role = next((v for k, v in attributes.items() if k.lower() == "role"), "") or None  # written Role or role
        row = {"node": key, "parent": up and up["node"], "kind": kind, "tag": tag, "role": role, "depth": len(self.open), "child_ord": up["children"] if up else 1, f"{kind}_ord": self.n[kind], "enter": self.n["step"], "children": 0, "above": [x["node"] for x in self.open] if kind == "word" else None}
        if kind == "word":
            for x in self.open:
                x.setdefault("leftmost", key)
        self.rows.append(row)
        self.open.append(row)

    def leave(self, tag: str) -> None:
        if tag in self.wrappers:
            return
        row = self.open.pop()
        self.n["step"] += 1
        row["leave"] = self.n["step"]
        if row["kind"] == "group" and not row["children"]:
            raise TreeError(f"empty group {row['node']}")

    def read(self, text: str | None) -> list[dict]:
        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler = self.enter, self.leave
        try:
            parser.Parse(text or "", True)
            if not self.rows:
                raise TreeError("no root")
        except (TreeError, expat.ExpatError) as e:
            return [{"kind": "error", "error": str(e) if isinstance(e, TreeError) else f"not well formed: {e}"}]
        return self.rows


def tree_forest(docs: DataFrame, ident: str, text: str, groups: tuple[str, ...] = ("wg",), words: tuple[str, ...] = ("w",), wrappers: tuple[str, ...] = ("sentence", "book"), key: str = "id") -> DataFrame:
    """(ident, node, parent, kind, tag, role, depth, child_ord, group_ord, word_ord, enter, leave, leftmost, above, error): a row for each group and word.

    kind is group, word or error; leftmost is a group's first word; above lists a word's groups from the root. Wrappers
    are passed through. A document that is no tree gives one error row; null text is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (frozenset(groups), frozenset(words), frozenset(wrappers))
        for b in batches:
            rows, of = [], []
            for i, x in enumerate(b["_text"]):
                own = _Walk(*sets, key).read(x.as_py())
                rows += own
                of += [i] * len(own)
                if len(rows) >= ROWS or i == b.num_rows - 1:
                    columns = [pa.array([r.get(c) for r in rows], pa.string() if c in ("node", "parent", "kind", "tag", "role", "leftmost", "error") else pa.int64()) for c in FIELDS]
                    yield pa.RecordBatch.from_arrays([b[ident].take(pa.array(of, pa.int64())), *columns, pa.array([r.get("above") for r in rows], pa.list_(pa.string()))], names=[ident, *FIELDS, "above"])
                    rows, of = [], []

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, F.col(text).alias("_text")).mapInArrow(run, f"`{ident}` {kind}, {SCHEMA}")


def leaf_closure(forest: DataFrame, ident: str) -> DataFrame:
    """(ident, anc, leaf, dist): the groups that each word lies in, from the lists of the walk; nothing is joined or shuffled."""
    rows = forest.where("kind = 'word'").select(ident, F.col("node").alias("leaf"), F.posexplode(F.reverse("above")).alias("up", "anc"))
    return rows.select(ident, "anc", "leaf", (F.col("up") + 1).cast("long").alias("dist"))


def tree_errors(forest: DataFrame, ident: str) -> DataFrame:
    return forest.where("kind = 'error'").select(ident, "error")
