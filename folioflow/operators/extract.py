"""Model-backed extraction behind an interface (EXT01, EXT02, EXT04, EXT05, AGG17)."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a client gives for (system, user): the answer's text and usage figures.
Client = Callable[[str, str], tuple[str, dict]]

SCHEMA = "contract_name string, chunk_id int, prediction string, raw string, attempts int, duration_s double, input_tokens long, output_tokens long, cached_tokens long, reasoning_tokens long, error string"


def extract_one(client: Client, system: str, user: str, attempts: int = 3, pause: float = 2.0) -> dict:
    """EXT01: up to ``attempts`` calls with growing pauses; an answer that does not parse counts as failed. A later success clears the error."""
    began, error, raw, usage, tried = time.monotonic(), None, None, {}, 0
    for tried in range(1, attempts + 1):
        try:
            raw, usage = client(system, user)
            json.loads(raw)
            return {"prediction": raw, "raw": None, "attempts": tried, "usage": usage, "error": None, "duration_s": round(time.monotonic() - began, 2)}
        except Exception as e:  # noqa: BLE001  a client may raise anything; the record keeps it
            error = f"{type(e).__name__}: {e}"
            if tried < attempts:
                time.sleep(pause * tried)
    return {"prediction": None, "raw": raw, "attempts": tried, "usage": usage, "error": error, "duration_s": round(time.monotonic() - began, 2)}


def extract(chunks: DataFrame, make_client: Callable[[], Client], system: str, pause: float = 2.0) -> DataFrame:
    """EXT01, EXT02: every chunk (contract_name, chunk_id, input) through a client, made once for each task.

    Any backend fits, a remote API or a constrained local decoder. Failures are
    rows with a null prediction and the raw text; resume by ``corpus.todo``
    against the rows with one. Filter before this step: Spark cannot push
    filters through it.
    """

    def run(batches):
        client = make_client()
        for b in batches:
            rows = [extract_one(client, system, u, pause=pause) for u in b.column(2).to_pylist()]
            usage = [r["usage"] or {} for r in rows]
            figures = [[u.get("input_tokens") for u in usage], [u.get("output_tokens") for u in usage], [(u.get("input_tokens_details") or {}).get("cached_tokens") for u in usage], [(u.get("output_tokens_details") or {}).get("reasoning_tokens") for u in usage]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array([r[k] for r in rows], t) for k, t in (("prediction", pa.string()), ("raw", pa.string()), ("attempts", pa.int32()), ("duration_s", pa.float64()))], *[pa.array(f, pa.int64()) for f in figures], pa.array([r["error"] for r in rows], pa.string())],
                names=["contract_name", "chunk_id", "prediction", "raw", "attempts", "duration_s", "input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "error"],
            )

    return chunks.select("contract_name", F.col("chunk_id").cast("int"), "input").mapInArrow(run, SCHEMA)


def recorded(make_client: Callable[[], Client], system: str, pause: float = 2.0) -> Callable[[], Callable[[dict], dict]]:
    """EXT01 as the work of a record log: a chunk's row into the record of its answer, with the columns of ``SCHEMA``."""

    def make_work():
        client = make_client()

        def work(row: dict) -> dict:
            r = extract_one(client, system, row["input"], pause=pause)
            u = r.pop("usage") or {}
            figures = {"input_tokens": u.get("input_tokens"), "output_tokens": u.get("output_tokens"), "cached_tokens": (u.get("input_tokens_details") or {}).get("cached_tokens"), "reasoning_tokens": (u.get("output_tokens_details") or {}).get("reasoning_tokens")}
            return {"contract_name": row["contract_name"], "chunk_id": row["chunk_id"]} | r | figures

        return work

    return make_work


# The white space of JSON.
BLANK = " \t\r\n"
_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*+("?)', re.S)


def open_blanks(text: str) -> int:
    """EXT03 on the driver: white space at the end of a JSON text that stands between its tokens; -1 inside a string."""
    last = None
    for last in _STRINGS.finditer(text):
        pass
    if last and not last[1]:
        return -1
    rest = text[last.end() :] if last else text
    return len(rest) - len(rest.rstrip(BLANK))


def constrained_decode(step: Callable[[list[int]], list[float]], allowed: Callable[[list[int]], list[int]], end: int, most: int = 3_072, surface: Callable[[int], str] | None = None, blanks: set[int] | frozenset[int] = frozenset(), most_blanks: int = 2) -> list[int]:
    """EXT02: greedy decoding under a grammar: a lone legal token is taken without a model step, otherwise the legal one of highest score.

    With ``surface`` (a token's text) and ``blanks`` (EXT04), tokens of white space
    are no longer legal once ``most_blanks`` blanks stand between tokens of the
    answer, unless nothing else is; inside strings they always are. 0 sets no cap.
    """
    out: list[int] = []
    text = ""
    while len(out) < most:
        legal = allowed(out)
        if not legal:
            break
        if len(legal) == 1:
            token = legal[0]
        else:
            if blanks and most_blanks > 0 and open_blanks(text) >= most_blanks:
                legal = [x for x in legal if x not in blanks] or legal
            scores = step(out)
            token = max(legal, key=lambda x: (scores[x], -x))
        if token == end:
            break
        out.append(token)
        text += surface(token) if surface else ""
    return out


def decoded(rows: DataFrame, inputs: list[str], make_decoder: Callable[[], Callable[[dict], str]], name: str = "answer") -> DataFrame:
    """EXT02: the inputs and what a decoder, made once for each task, answers to each row: ``constrained_decode`` with a model's scores and a grammar of the row. A map; rows go to it as they are."""
    schema = rows.select(*inputs).schema.add(name, "string")

    def run(batches):
        decode = None
        for b in batches:
            decode = decode or make_decoder()
            answers = [decode(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], names=[*inputs, name])

    return rows.select(*inputs).mapInArrow(run, schema)


def is_blank_token(token: str) -> Column:
    """EXT04: is a token of a vocabulary white space only (also as byte-level vocabularies write it)? The empty one is not."""
    return (F.col(token) != "") & (F.translate(token, BLANK + "ĠĊ", "") == "")


def blank_tokens(vocabulary: DataFrame, token: str = "token", number: str = "id") -> DataFrame:
    """EXT04: ids of tokens that are white space only."""
    return vocabulary.where(is_blank_token(token)).select(number)


def usage_summary(log: DataFrame) -> DataFrame:
    """AGG17: calls, successes, tokens and wall time of a run log. Reasoning tokens are read where they are kept, in the output details."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return log.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNull()).alias("succeeded"), zero("usage.input_tokens").alias("input_tokens"), zero("usage.input_tokens_details.cached_tokens").alias("cached_tokens"),
        zero("usage.output_tokens").alias("output_tokens"), zero("usage.output_tokens_details.reasoning_tokens").alias("reasoning_tokens"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("wall_s"),
    )
