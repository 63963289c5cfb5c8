"""URL filters by a bit-parallel wildcard automaton.

Glob rules (`*` any run, `?` any byte) over the canonical url are packed side by side into the bits of a few 64-bit words.
One Shift-And step for each byte moves every pattern of every url of a batch at once: a literal's state moves on if the byte's
mask has its bit, a state before a `*` also stays.  Host rules with path prefixes come first; the automaton decides the rest.

The canonical url is the host with A-Z lower-cased and the path, without scheme, query and fragment, as UTF-8 bytes.

Cases: a null url, or one without `://`, has an empty host and path and is allowed; repeated rows are judged alike; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict)
HOST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
BLOCK_GLOBS = ["*spam-farm*", "*cheap-pills*", "*casino*", "*/login*", "*/admin/*", "*.exe", "*/cart/*", "*/print/?*", "ads.*"]
MOST_GLOBS = 20_000


def globs_of(rules: DataFrame, most: int = MOST_GLOBS) -> list[str]:
    """The distinct globs of a rule table (glob), sorted; the automaton goes to every task, so a table of more than `most` is refused."""
    found = [r["glob"] for r in rules.where(F.col("glob").isNotNull()).select("glob").distinct().orderBy("glob").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} globs")
    return found


class GlobAutomaton:
    """All patterns in one set of words; match() says which texts any pattern fits whole."""

    def __init__(self, globs: list[str]):
        import numpy as np

        states: list[tuple[bytes | None, bool]] = []  # (byte that enters the state, None: any), stays on any byte
        first, last = [], []
        for glob in globs:
            first.append(len(states))
            states.append((b"", False))
            for c in glob:
                if c == "*":
                    states[-1] = (states[-1][0], True)
                elif c == "?":
                    states.append((None, False))
                else:
                    states += [(bytes([b]), False) for b in c.encode()]
            last.append(len(states) - 1)
        words = max(1, -(-len(states) // 64))

        def pack(bits) -> "np.ndarray":
            out = np.zeros(words, "u8")
            for i in bits:
                out[i // 64] |= np.uint64(1 << (i % 64))
            return out

        self.begin, self.end = pack(first), pack(last)
        self.stay = pack(i for i, (_, s) in enumerate(states) if s)
        self.enter = np.array([pack(i for i, (b, _) in enumerate(states) if b is None or b == bytes([c])) for c in range(256)])

    def match(self, texts: list[bytes]):
        import numpy as np

        sizes = np.array([len(t) for t in texts], "i8")
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", "u1")
        at = np.r_[0, np.cumsum(sizes)[:-1]][order] if len(texts) else sizes
        state = np.tile(self.begin, (len(texts), 1))
        sizes = sizes[order]
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, "left"))  # texts longer than step
            s = state[:n]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:n] = (moved & self.enter[data[at[:n] + step]]) | (s & self.stay)
        hit = np.zeros(len(texts), bool)
        hit[order] = (state & self.end).any(axis=1)
        return hit


def host_and_path(url: Column) -> tuple[Column, Column]:
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, shape, 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def host_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _globs(globs: list[str], columns: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = GlobAutomaton(globs)
        for batch in batches:
            urls = [(h + p).encode("utf-8", "surrogatepass") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            hit = automaton.match(urls)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(hit)], [*columns, "glob_hit"])

    return run


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = HOST_RULES, globs: list[str] | DataFrame = BLOCK_GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row; globs is a list, or a rule table with a column glob."""
    globs = globs_of(globs) if isinstance(globs, DataFrame) else globs
    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.mapInArrow(_globs(globs, ["page_id", "host", "path"]), "page_id long, host string, path string, glob_hit boolean")
    rule, verdict = host_rule(rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("glob_hit"), "block").otherwise("allow")).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    say = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    like = " OR ".join("host || path LIKE '" + g.replace("*", "%").replace("?", "_") + "'" for g in BLOCK_GLOBS)
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path
  FROM pages
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {say} WHEN {like} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


ORACLE_SQL = _sql()
