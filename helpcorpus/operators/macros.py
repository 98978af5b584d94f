"""Auditing the macro programs of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import context_hash, linked_identity
from .links import documents_by_identity, topic_mode
from .resolve import contents_topic, resolve_topic_offset

# Bounds of a program.
TEXT_BYTES, CALLS, ARGUMENTS, DEPTH, STRING_BYTES = 64 * 1024, 256, 16, 16, 32 * 1024
# Macro names, with their short form where they have one.
NAMES = (
    ("About", None), ("AddAccelerator", "AA"), ("ALink", "AL"), ("Annotate", None), ("AppendItem", None), ("Back", None), ("BackFlush", "BF"),
    ("BookmarkDefine", None), ("BookmarkMore", None), ("BrowseButtons", None), ("ChangeButtonBinding", "CBB"), ("ChangeEnable", "CE"),
    ("ChangeItemBinding", "CIB"), ("CheckItem", "CI"), ("CloseSecondarys", "CS"), ("CloseWindow", "CW"), ("Compare", None), ("Contents", None),
    ("ControlPanel", None), ("CopyDialog", None), ("CopyTopic", "CT"), ("CreateButton", "CB"), ("DeleteItem", None), ("DeleteMark", None),
    ("DestroyButton", None), ("DisableButton", "DB"), ("DisableItem", "DI"), ("EnableButton", "EB"), ("EnableItem", "EI"), ("EndMPrint", None),
    ("ExecFile", "EF"), ("ExecProgram", "EP"), ("Exit", None), ("ExtAbleItem", None), ("ExtInsertItem", None), ("ExtInsertMenu", None),
    ("FileExist", "FE"), ("FileOpen", "FO"), ("Find", None), ("Finder", "FD"), ("FloatingMenu", None), ("Flush", "FH"), ("FocusWindow", None),
    ("Generate", None), ("GotoMark", None), ("HelpOn", None), ("HelpOnTop", None), ("History", None), ("InitMPrint", None), ("InsertItem", None),
    ("InsertMenu", None), ("IfThen", "IF"), ("IfThenElse", "IE"), ("IsBook", None), ("IsMark", None), ("IsNotMark", "NM"), ("JumpContents", None),
    ("JumpContext", "JC"), ("JumpHash", "JH"), ("JumpHelpOn", None), ("JumpID", "JI"), ("JumpKeyword", "JK"), ("KLink", "KL"), ("Menu", "MU"),
    ("MPrintHash", None), ("MPrintID", None), ("Next", None), ("NoShow", "NS"), ("PopupContext", "PC"), ("PopupHash", None), ("PopupId", "PI"),
    ("PositionWindow", "PW"), ("Prev", None), ("Print", None), ("PrinterSetup", None), ("RegisterRoutine", "RR"), ("RemoveAccelerator", "RA"),
    ("ResetMenu", None), ("SaveMark", None), ("Search", None), ("SetContents", None), ("SetHelpOnFile", None), ("SetPopupColor", "SPC"),
    ("ShellExecute", "SE"), ("ShortCut", "SH"), ("TCard", None), ("Test", None), ("TestALink", None), ("TestKLink", None), ("UncheckItem", "UI"),
    ("UpdateWindow", "UW"),
)
# What may run, by the types of its arguments (S string, I number), and classes of what may not.
ALLOWED = {"ALink": "S", "About": "", "Back": "", "BackFlush": "", "BookmarkDefine": "", "BookmarkMore": "", "BrowseButtons": "", "Contents": "", "Finder": "", "FocusWindow": "S", "History": "", "JumpContents": "SS", "JumpContext": "SSI", "JumpHash": "SSI", "JumpID": "SS", "Next": "", "Prev": "", "PopupContext": "SI", "PopupHash": "SI", "PopupId": "SS", "Search": "", "SetPopupColor": "III"}
EXTERNAL, DYNAMIC, HOST = ("ExecFile", "ExecProgram", "ShellExecute", "ShortCut", "ControlPanel"), ("RegisterRoutine",), ("FileExist", "Generate", "TCard")

CALLS_DDL = "doc string, origin string, call_no int, name string, arg_types string, args array<string>, error_offset int, error string"
_CALLS = pa.schema([("doc", pa.string()), ("origin", pa.string()), ("call_no", pa.int32()), ("name", pa.string()), ("arg_types", pa.string()), ("args", pa.list_(pa.string())), ("error_offset", pa.int32()), ("error", pa.string())])


class _Malformed(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class _Reader:
    """One pass over a program; a call is (name, [(type, text)])."""

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def fail(self, message: str, at: int | None = None):
        raise _Malformed(len(self.s[: self.i if at is None else at].encode()), message)

    def space(self) -> str:
        while self.i < len(self.s) and self.s[self.i] in " \t\n\r\f":
            self.i += 1
        return self.s[self.i : self.i + 1]

    def need(self, c: str, message: str) -> None:
        if self.s[self.i : self.i + 1] != c:
            self.fail(message)
        self.i += 1

    def program(self) -> Iterator[tuple]:
        n = 0
        while self.space():
            if n >= CALLS:
                self.fail("too many calls")
            yield self.call(0)
            n += 1
            if not self.space():
                return
            self.need(";", "expected ';' between calls")

    def call(self, depth: int) -> tuple:
        if depth >= DEPTH:
            self.fail("nested too deeply")
        c, start = self.space(), self.i
        if not (c.isascii() and c.isalpha()):
            self.fail("expected a name")
        while self.i < len(self.s) and self.s[self.i].isascii() and (self.s[self.i].isalnum() or self.s[self.i] == "_"):
            self.i += 1
        name, args = self.s[start : self.i], []
        self.space()
        self.need("(", "expected '(' after a name")
        while self.space() != ")" or args:
            if len(args) >= ARGUMENTS:
                self.fail("too many arguments")
            args.append(self.argument(depth + 1))
            if self.space() == ")":
                break
            self.need(",", "expected ',' or ')' after an argument")
        self.need(")", "expected ')' after arguments")
        return name, args

    def argument(self, depth: int) -> tuple[str, str]:
        c = self.space()
        if c and c in "`'\"":
            return "S", self.string()
        if c and (c in "+-" or c in "0123456789"):
            return "I", str(self.number())
        if c.isascii() and c.isalpha():
            name, args = self.call(depth)
            return "C", f"{name}({', '.join(a for _, a in args)})"
        return self.fail("unknown argument" if c else "unexpected end")

    def number(self) -> int:
        import re

        m = re.compile(r"([+-]?)(0[xX]([0-9a-fA-F]*)|[0-9]+)").match(self.s, self.i)
        if not m or m[3] == "":
            self.fail("a number without digits")
        start, self.i = self.i, m.end()
        n = int(m[3], 16) if m[3] else int(m[2])
        if m[3]:
            if n >= 1 << 32:
                self.fail("number out of range", start)
            n = -n if m[1] == "-" else n - (1 << 32) * (n >= 1 << 31)
        elif m[1] == "-":
            n = -n
        if not -(1 << 31) <= n < 1 << 31:
            self.fail("number out of range", start)
        return n

    def string(self) -> str:
        start, out = self.i, []
        open_quotes = [self.s[self.i]]
        self.i += 1
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == "\\":
                if self.i >= len(self.s):
                    self.fail("a trailing escape", self.i - 1)
                out.append(self.s[self.i])
                self.i += 1
                continue
            if c == "`" or (c == '"' and open_quotes[-1] != '"'):
                if len(open_quotes) >= DEPTH:
                    self.fail("quotes nested too deeply", self.i - 1)
                open_quotes.append(c)
            elif c in "'\"":
                open_quotes.pop()
                if not open_quotes:
                    text = "".join(out)
                    if len(text.encode()) > STRING_BYTES:
                        self.fail("a string too long", start)
                    return text
            out.append(c)
        return self.fail("a string without an end", start)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, origin, text in zip(b["doc"].to_pylist(), b["origin"].to_pylist(), b["text"].to_pylist(), strict=True):
            calls, error = [], None
            try:
                if len((text or "").encode()) > TEXT_BYTES:
                    raise _Malformed(0, "text too long")
                calls = list(_Reader(text or "").program())
            except _Malformed as e:
                error = e
            if error:
                out.append((doc, origin, None, None, None, None, error.at, error.message))
            else:
                out += [(doc, origin, i, name, "".join(t for t, _ in args), [a for _, a in args], None, None) for i, (name, args) in enumerate(calls)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_CALLS.types)], schema=_CALLS)


def macro_calls(macros: DataFrame) -> DataFrame:
    """Rows of calls for each program (doc, origin, text), or one row with the byte at which it is malformed. Quotes nest, so programs are read in Arrow batches."""
    return macros.select("doc", "origin", "text").mapInArrow(_read, CALLS_DDL)


def dictionary(spark: SparkSession) -> DataFrame:
    """(spelling, canonical, signature, block): all names and short forms; 125 rows, so any join broadcasts it."""
    rows, seen = [], set()
    for name, short in NAMES:
        block = "ExternalExecution" if name in EXTERNAL else "DynamicCode" if name in DYNAMIC else "HostInteraction" if name in HOST else "UnsupportedViewerOperation"
        for spelling in (name.lower(), *([short.lower()] if short else [])):
            if spelling not in seen:
                seen.add(spelling)
                rows.append((spelling, name, ALLOWED.get(name), block))
    return spark.createDataFrame(rows, "spelling string, canonical string, signature string, block string")


def macro_canonical_name(calls: DataFrame) -> DataFrame:
    """calls with canonical, null for unknown names; case does not matter."""
    d = F.broadcast(dictionary(calls.sparkSession))
    return calls.withColumn("spelling", F.lower(F.trim("name"))).join(d, "spelling", "left").drop("spelling")


def macro_policy(calls: DataFrame) -> DataFrame:
    """calls with verdict and reason; a program that could not be read is blocked as Malformed."""
    d = macro_canonical_name(calls)
    colour = (F.col("canonical") != "SetPopupColor") | F.forall("args", lambda a: F.expr("true") & a.try_cast("int").between(0, 255))
    fits = F.coalesce((F.col("signature") == F.col("arg_types")) & colour, F.lit(False))
    reason = F.when(F.col("error").isNotNull(), "Malformed").when(fits, None).when(F.col("canonical").isNull(), "UnknownOperation").when(F.col("signature").isNotNull(), "InvalidArguments").otherwise(F.col("block"))
    return d.withColumn("reason", reason).withColumn("verdict", F.when(fits, "ALLOW").otherwise("BLOCK")).drop("signature", "block")


def macro_policy_summary(policy: DataFrame) -> DataFrame:
    return policy.groupBy("doc", "origin", "verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


def _arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def macro_link_targets(policy: DataFrame) -> DataFrame:
    """Edges of allowed navigation calls: help_file, win_name, target_kind (Contents, Map, Hash, Id), target, popup. A path and window in one argument split at >."""
    name = F.col("canonical")
    kind = F.when(name.isin("Contents", "JumpContents"), "Contents").when(name.isin("JumpContext", "PopupContext"), "Map").when(name.isin("JumpHash", "PopupHash"), "Hash").when(name.isin("JumpID", "PopupId"), "Id")
    popup = name.startswith("Popup")
    path = F.when(name == "JumpID", F.substring_index(_arg(0), ">", 1)).otherwise(_arg(0))
    win = F.when(name == "JumpID", F.when(F.instr(_arg(0), ">") > 0, F.substring_index(_arg(0), ">", -1))).when(name.isin("JumpContents", "JumpContext", "JumpHash"), _arg(1))
    target = F.when(kind == "Id", _arg(1)).when(kind.isin("Map", "Hash"), F.when(popup, _arg(1)).otherwise(_arg(2)))
    d = policy.where("verdict = 'ALLOW'").withColumn("target_kind", kind).where("target_kind is not null")
    return d.select("doc", "origin", "call_no", F.coalesce(F.trim(path), F.lit("")).alias("help_file"), F.nullif(F.trim(win), F.lit("")).alias("win_name"), "target_kind", target.alias("target"), popup.alias("popup"))


def _addresses(contexts: DataFrame, context_map: DataFrame) -> DataFrame:
    """(doc, kind, key, offset): the first entry of each hash and map number of a document, in one table."""
    named = contexts.select("doc", F.lit("hash").alias("_kind"), F.col("hash").alias("_key"), "ord", "topic_offset")
    numbered = context_map.select("doc", F.lit("map").alias("_kind"), F.col("map_id").alias("_key"), "ord", "topic_offset")
    return named.unionByName(numbered).where("_key is not null").groupBy("doc", "_kind", "_key").agg(F.min_by("topic_offset", "ord").alias("_offset"))


def macro_link_edges(
    targets: DataFrame, docs: DataFrame, contexts: DataFrame, context_map: DataFrame, topic_map: DataFrame, topics: DataFrame, anchors: DataFrame, default_windows: DataFrame, windows: DataFrame
) -> DataFrame:
    """macro_link_targets' rows with dst_doc, dst_topic, mode, win, and message where they lead nowhere.

    A file is looked up from the calling document's folder; without one it is that document. Map numbers,
    hashes and names (by their hash) are one kind of key each in one table of addresses, so one join and
    one as-of pass resolve them all; contents are the document's contents topic. A hash is not tried as an
    offset here. docs(doc, contents_offset): the known documents.
    """
    d = targets.withColumn("identity", linked_identity(F.col("doc"), F.col("help_file"))).join(documents_by_identity(docs), "identity", "left").drop("identity")
    number = F.col("target").try_cast("int")
    key = F.when(F.col("target_kind") == "Id", context_hash(F.col("target"))).when(F.col("target_kind").isin("Map", "Hash"), number)
    d = d.withColumn("_kind", F.when(F.col("target_kind") == "Map", "map").otherwise("hash")).withColumn("_key", key).withColumnRenamed("doc", "_src").withColumnRenamed("dst_doc", "doc")
    d = resolve_topic_offset(d.join(_addresses(contexts, context_map), ["doc", "_kind", "_key"], "left"), anchors, "_offset", "_found").drop("_kind", "_key", "_offset")
    first = contents_topic(docs, topic_map, topics, anchors).withColumnRenamed("topic_index", "_contents")
    d = d.join(first, "doc", "left").withColumn("dst_topic", F.when(F.col("target_kind") == "Contents", F.col("_contents")).otherwise(F.col("_found"))).drop("_contents", "_found")
    d = d.withColumnRenamed("doc", "dst_doc").withColumnRenamed("_src", "doc").withColumn("win_number", F.lit(None).cast("int"))
    d = topic_mode(d, anchors, default_windows, windows).drop("win_number")
    lost = F.concat(F.lit("Unresolved macro "), F.lower("target_kind"), F.when(F.col("target").isNull(), "").otherwise(F.concat(F.lit(" "), "target")), F.lit(" in "), "dst_doc")
    return d.withColumn("message", F.when(F.col("dst_doc").isNull(), "The linked HLP was not embedded in this HTML export.").when(F.col("dst_topic").isNull(), lost))
