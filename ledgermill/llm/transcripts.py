"""Chat formatting: roles of raw transcripts by a hidden Markov model, rendered canonically.

A transcript is a sequence of lines. Each line is in a state: a role, and whether it begins a
turn. Lines show a speaker marker (or none), whether a blank line came before, how they end and
how long they are. Start, transition and feature probabilities are counted from labelled
transcripts; Viterbi then finds the likeliest states, so turns without a marker are recovered
from the lines around them.

Lines are put in order by a range shuffle on (transcript, place) and packed into segments of at
most SEGMENT lines. A transcript of any length is then several bounded rows: each segment gives
a matrix of best scores between its borders, a transcript's matrices give the states at the
borders, and each segment is decoded alone between them. The result is the exact Viterbi path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2  # role x (begins a turn, goes on)
SEGMENT = 2000  # lines
SMOOTHING = 0.5  # added to every count

# Speaker markers by role, as they open a line in the transcripts people keep.
MARKERS = {
    "system": r"system|context|<\|system\|>|\[system\]|### system",
    "user": r"user|human|question|q|customer|<\|user\|>|\[user\]|### instruction",
    "assistant": r"assistant|ai|bot|answer|a|agent|<\|assistant\|>|\[assistant\]|### response",
}
_MARKER = re.compile(
    r"\s*(?:" + "|".join(f"(?P<{role}>{names})" for role, names in MARKERS.items()) + r"|(?P<other>[A-Z]\w{0,20}(?= ?:)))"
    r"(?:\s*[:>]|(?<=[\]>]))\s*", re.IGNORECASE,
)
MARKER_KINDS = (*ROLES, "other", "none")
FEATURES = {"marker": len(MARKER_KINDS), "after_blank": 2, "ending": 4, "length": 4}


def line_features(line: str, after_blank: bool) -> tuple[int, int, int, int]:
    """Marker kind, whether a blank line came before, kind of ending, length class."""
    found = _MARKER.match(line)
    kind = MARKER_KINDS.index(found.lastgroup) if found else len(MARKER_KINDS) - 1
    body = line[found.end():] if found else line
    end = body.rstrip()[-1:]
    ending = 0 if end in ".!" and end else 1 if end == "?" else 2 if end in ",;:" and end else 3
    return kind, int(after_blank), ending, min(3, len(body) // 60)


def without_marker(line: str) -> str:
    found = _MARKER.match(line)
    return line[found.end():] if found else line


# ---- lines in order ------------------------------------------------------------------------------

LINE = "struct<blank:boolean,before:array<struct<line:string,role:string,n:bigint>>,line:string,role:string,begins:boolean>"


def pack_segments(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Ordered lines in bounded rows: conv_id, part, number, lines (array of LINE).

    ``lines`` has conv_id, place (any ordered column), line and, for labelled ones, role and
    begins. Blank lines are no lines of their own: the next line holds them in ``before``, equal
    ones that follow each other as one entry with their number. A transcript's first line counts
    as after a blank; blank lines after its last line are dropped.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv, held, gap, first = object(), [], [], True

        def flush(kind) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], kind), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([held], pa.list_(pa.struct([("blank", pa.bool_()), ("before", before), ("line", pa.string()),
                                                      ("role", pa.string()), ("begins", pa.bool_())])))],
                names=["conv_id", "part", "number", "lines"],
            )

        before = pa.list_(pa.struct([("line", pa.string()), ("role", pa.string()), ("n", pa.int64())]))
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for own, line, role, begins in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (own != conv or len(held) == segment):
                    yield flush(kind)
                    number, held = number + 1, []
                if own != conv:
                    conv, gap, first = own, [], True
                if not line.strip():
                    if gap and (gap[-1]["line"], gap[-1]["role"]) == (line, role):
                        gap[-1]["n"] += 1
                    else:
                        gap.append({"line": line, "role": role, "n": 1})
                    continue
                held.append({"blank": first or bool(gap), "before": gap, "line": line, "role": role, "begins": begins})
                gap, first = [], False
        if held:
            yield flush(kind)

    kind = lines.schema["conv_id"].dataType.simpleString()
    ordered = lines.repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "line", "role", "begins").mapInArrow(
        pack, f"conv_id {kind}, part int, number int, lines array<{LINE}>"
    )


# ---- the model -----------------------------------------------------------------------------------

@dataclass
class TurnModel:
    """Log probabilities: start (S), step (S x S), and per feature (S x values)."""

    start: np.ndarray
    step: np.ndarray
    seen: list[np.ndarray]

    def scores(self, lines: list[dict]) -> np.ndarray:
        """Log probability of each line's features in each state."""
        features = np.array([line_features(x["line"], x["blank"]) for x in lines])
        return sum(table[:, features[:, k]] for k, table in enumerate(self.seen)).T


def _state(role: str | None, begins: bool | None) -> int | None:
    return 2 * ROLES.index(role) + (0 if begins else 1) if role in ROLES and begins is not None else None


def fit_model(segments: DataFrame) -> TurnModel:
    """Count the model from labelled segments. Unknown roles are passed over.

    Tasks add up their counts; the driver gets one number per pair of states and feature value.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for lines in batch.column(0).to_pylist():
                last = None
                for k, x in enumerate(lines):
                    state = _state(x["role"], x["begins"])
                    if state is not None:
                        if k == 0 and x["begins"]:
                            totals["start", state, 0] = totals.get(("start", state, 0), 0) + 1
                        if last is not None:
                            totals["step", last, state] = totals.get(("step", last, state), 0) + 1
                        for name, value in zip(FEATURES, line_features(x["line"], x["blank"]), strict=True):
                            totals[name, state, value] = totals.get((name, state, value), 0) + 1
                    last = state
        yield pa.RecordBatch.from_pydict(
            {"what": [k[0] for k in totals], "a": [k[1] for k in totals], "b": [k[2] for k in totals], "n": list(totals.values())},
            schema=pa.schema([("what", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    parts = segments.select("lines").mapInArrow(count, "what string, a long, b long, n long")
    tables = {"start": np.full((STATES, 1), SMOOTHING), "step": np.full((STATES, STATES), SMOOTHING)}
    tables |= {name: np.full((STATES, size), SMOOTHING) for name, size in FEATURES.items()}
    for row in parts.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[row["what"]][row["a"], row["b"]] += row["n"]
    begin = np.arange(STATES) % 2 == 0
    tables["start"][~begin] = 1e-9  # a transcript begins with a turn
    for a in range(STATES):  # a line goes on only in the role of the line before
        tables["step"][a, [b for b in range(STATES) if b % 2 and b // 2 != a // 2]] = 1e-9
    logs = {name: np.log(t / t.sum(axis=0 if name == "start" else 1, keepdims=True)) for name, t in tables.items()}
    return TurnModel(logs["start"][:, 0], logs["step"], [logs[name] for name in FEATURES])


def transfer(model: TurnModel, lines: list[dict]) -> np.ndarray:
    """Best score from each state of the first line to each state of the last, both included."""
    scores = model.scores(lines)
    best = np.where(np.eye(STATES, dtype=bool), scores[0], -np.inf)
    for row in scores[1:]:
        best = (best[:, :, None] + model.step[None]).max(axis=1) + row
    return best


def best_path(model: TurnModel, lines: list[dict], first: int, last: int) -> list[int]:
    """The likeliest states of a segment whose first and last states are given; ties take the lower."""
    scores = model.scores(lines)
    best = np.full(STATES, -np.inf)
    best[first] = scores[0, first]
    back = []
    for row in scores[1:]:
        paths = best[:, None] + model.step
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    path = [last]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def border_states(model: TurnModel, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last state of each segment on the best path through all of them."""
    best, choices = model.start, []
    for k, matrix in enumerate(matrices):
        entry = best if k == 0 else (best[:, None] + model.step).max(axis=0)
        came = None if k == 0 else (best[:, None] + model.step).argmax(axis=0)
        paths = entry[:, None] + matrix
        choices.append((paths.argmax(axis=0), came))
        best = paths.max(axis=0)
    last, out = int(best.argmax()), []
    for first_of, came in reversed(choices):
        first = int(first_of[last])
        out.append((first, last))
        if came is not None:
            last = int(came[first])
    return out[::-1]


# ---- parsing -------------------------------------------------------------------------------------

def turn_text(lines: list[dict], begins: bool, goes_on: bool) -> str:
    """The lines of a turn, or of a piece of it, with the blank lines between them.

    Blank lines before the first line of a turn only part it from the turn before. White space
    at a turn's two ends is dropped, at the borders of its pieces it is kept.
    """
    body = []
    for k, x in enumerate(lines):
        if begins and k == 0:
            body.append(without_marker(x["line"]))
            continue
        for gap in x["before"]:
            body += [gap["line"]] * gap["n"]
        body.append(x["line"])
    text = "\n".join(body)
    text = text.lstrip() if begins else text
    return text if goes_on else text.rstrip()


def parse_segments(segments: DataFrame, model: TurnModel) -> DataFrame:
    """Canonical turns: conv_id, turn (from 0), piece, role, n_lines, text, n_right.

    A turn longer than a segment comes in several pieces, whose texts joined with line breaks
    are the turn's. ``n_lines`` counts its lines, with the blank ones between them; ``n_right``
    those of them whose given role was recovered. ``segments`` is read three times and should be
    a written table. A transcript without lines has no turns.
    """
    shared = segments.sparkSession.sparkContext.broadcast(model)
    kind = segments.schema["conv_id"].dataType.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [transfer(shared.value, lines).tobytes() for lines in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())],
                                             names=["conv_id", "part", "number", "matrix"])

    def borders(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("number", "ascending")])
        found = border_states(shared.value, [np.frombuffer(m, float).reshape(STATES, STATES) for m in table.column("matrix").to_pylist()])
        goes_on = [first % 2 == 1 for first, _ in found[1:]] + [False]
        return pa.table({"part": table.column("part"), "number": table.column("number"),
                         "first": pa.array([a for a, _ in found], pa.int32()), "last": pa.array([b for _, b in found], pa.int32()),
                         "goes_on": pa.array(goes_on, pa.bool_())})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("at", pa.int32()), ("begins", pa.bool_()),
                            ("role", pa.string()), ("n_lines", pa.int64()), ("text", pa.string()), ("n_right", pa.int64())])
        for batch in batches:
            out, convs = {name: [] for name in schema.names}, []
            for row, (part, number, lines, first, last, goes_on) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                path = best_path(shared.value, lines, first, last)
                cuts = [0, *[k for k in range(1, len(path)) if path[k] % 2 == 0], len(path)]
                for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    begins, role = path[a] % 2 == 0, ROLES[path[a] // 2]
                    own = lines[a:b]
                    gaps = [gap for x in own[begins:] for gap in x["before"]]
                    n_lines = b - a + sum(gap["n"] for gap in gaps)
                    n_right = sum(x["role"] == role for x in own) + sum(gap["n"] for gap in gaps if gap["role"] == role)
                    text = turn_text(own, begins, goes_on and b == len(path))
                    values = (part, number, at, begins, role, n_lines, text, n_right)
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
                    convs.append(row)
            rest = pa.RecordBatch.from_pydict(out, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(convs, pa.int64())), *rest.columns],
                                             names=["conv_id", *schema.names])

    # Border states only need the small matrices. Nearly all transcripts are one segment.
    small = stage(segments.select("conv_id", "part", "number", "lines").mapInArrow(
        matrices, f"conv_id {kind}, part int, number int, matrix binary"), "op4-matrices")
    ends = stage(small.groupBy("conv_id").applyInArrow(borders, "part int, number int, first int, last int, goes_on boolean"), "op4-borders")
    pieces = stage(
        segments.join(ends, ["part", "number"]).select("conv_id", "part", "number", "lines", "first", "last", "goes_on").mapInArrow(
            decode, f"conv_id {kind}, part int, number int, at int, begins boolean, role string, n_lines long, text string, n_right long"),
        "op4-pieces",
    )
    # Turns are numbered over segments first, so no window holds a transcript's lines.
    begun = pieces.groupBy("conv_id", "part", "number").agg(F.sum(F.col("begins").cast("long")).alias("_begun"))
    before = Window.partitionBy("conv_id").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = begun.select("part", "number", F.coalesce(F.sum("_begun").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("part", "number").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.join(starts, ["part", "number"]).withColumn(
        "turn", (F.col("_start") + F.sum(F.col("begins").cast("long")).over(inside) - 1).cast("long")
    )
    goes_on = Window.partitionBy("conv_id", "turn").orderBy("part", "number")
    return numbered.select(
        "conv_id", "turn", (F.row_number().over(goes_on) - 1).cast("long").alias("piece"), "role", "n_lines", "text", "n_right"
    )


def rendered(role: Column, text: Column) -> Column:
    """A turn in the canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


# ---- transcripts of the sample conversations -----------------------------------------------------

# Per style: the marker of system, user and assistant turns.
STYLES = [
    ("System: ", "User: ", "Assistant: "),
    ("System: ", "Human: ", "AI: "),
    ("Context: ", "Q: ", "A: "),
    ("<|system|>", "<|user|>", "<|assistant|>"),
    ("[SYSTEM] ", "[USER] ", "[ASSISTANT] "),
    ("### System: ", "### Instruction: ", "### Response: "),
]
MISSING = 10  # of 100 turns, those that lost their marker


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: conv_id, place, line, role, begins.

    Each conversation has one style of markers; every MISSING-th turn in 100 lost its marker. A
    blank line ends a turn. A null text is an empty turn, a null turn comes first, and turns of
    one number follow each other by role and text; equal rows follow each other whole.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(0)).cast("int")
    markers = F.array(*[F.array(F.lit(""), *map(F.lit, names)) for names in STYLES])
    lost = F.pmod(F.xxhash64("conv_id", "turn", F.lit("marker")), F.lit(100)) < MISSING
    marker = F.when(lost, "").otherwise(F.get(F.get(markers, style), number))
    text = F.concat(marker, F.coalesce("text", F.lit("")), F.lit("\n"))
    # Each row gets an id before its lines are exploded, so the lines of equal rows follow each
    # other whole instead of interleaving. Equal rows give equal lines, so which comes first
    # changes nothing, and no shuffle is needed.
    rows = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_copy"))
    split = rows.select("conv_id", "turn", "role", "text", "_copy", F.posexplode(F.split(text, "\n")).alias("k", "line"))
    place = F.struct("turn", "role", F.xxhash64("text").alias("h"), F.hash("text").alias("h2"), "_copy", "k")
    return split.select("conv_id", place.alias("place"), "line", "role", (F.col("k") == 0).alias("begins"))


def format_conversations(conversations: DataFrame, model: TurnModel | None = None) -> DataFrame:
    """Canonical turns of all conversations, with a model counted from them unless one is given."""
    segments = stage(pack_segments(conversation_lines(conversations)), "op4-segments")
    return parse_segments(segments, model or fit_model(segments))
