"""URL filters: the longest rule that fits, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.shared import added_name

#: A small labelled table: 1 blocks, 0 allows. Wikis, news, docs and papers against shops, logins, trackers and spam.
LABELLED_URLS = [
    ("https://www.example.edu/research/papers/2021/algebra.html", 0), ("https://docs.example.dev/guide/getting-started", 0), ("https://news.example.net/en/2020/05/science-report", 0),
    ("https://en.wiki.example.net/wiki/Topology", 0), ("https://library.example.edu/catalog/item/5521", 0), ("https://blog.example.io/articles/how-compilers-work", 0),
    ("http://history.example.net/en/essays/rome", 0), ("https://www.example.gov/reports/annual/2019", 0), ("https://forum.example.net/en/thread/812", 0),
    ("https://example.net/en/25", 0), ("https://m.example.net/en/310", 0), ("https://www.example.net/fr/17", 0), ("http://example.net/es/42", 0), ("https://example.net/de/77", 0),
    ("https://museum.example.edu/collection/painting/88", 0), ("https://recipes.example.net/fr/soupe/12", 0), ("https://health.example.gov/topics/sleep", 0),
    ("https://math.example.edu/lectures/linear-algebra/3", 0), ("https://example.com/en/story/99", 0), ("https://www.example.com/es/articulo/14", 0),
    ("https://example.com/en/825", 0), ("https://m.example.com/es/31", 0), ("http://www.example.com/en/6?page=2", 0), ("https://manual.example.dev/reference/api/index.html", 0),
    ("http://casino-bonus.example.net/win/free-spins", 1), ("https://cheap-pills.example.com/buy/viagra", 1), ("http://ads.example.net/click/track/9921", 1),
    ("https://tracker.example.com/pixel/beacon.gif", 1), ("https://shop.example.com/cart/checkout", 1), ("https://www.example.com/login/session", 1),
    ("http://xxx.example.net/adult/video/51", 1), ("https://download-crack.example.net/keygen/full", 1), ("http://free-casino.example.com/poker/bonus", 1),
    ("https://example.net/wp-admin/login.php", 1), ("http://spam.example.net/seo/backlinks/buy", 1), ("https://affiliate.example.com/ref/click/771", 1),
    ("https://example.com/cart/add/5512", 1), ("http://loans.example.net/payday/apply-now", 1), ("https://dating.example.com/adult/signup", 1),
    ("https://example.com/search/tag/feed/print", 1), ("http://pop.example.net/banner/ads/300", 1), ("https://coupon.example.com/deal/discount/buy", 1),
    ("http://torrent.example.net/download/warez/9", 1), ("https://accounts.example.com/signin/password/reset", 1), ("http://slots.example.net/jackpot/win/now", 1),
    ("https://example.net/cgi-bin/redirect/click", 1), ("https://lottery.example.com/prize/claim", 1), ("http://porn.example.net/xxx/gallery", 1),
]


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains of it, where the path starts with its path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """The chance that a URL is one to block."""
        at, values = grams(host, path, len(self.weights))
        return float(1 / (1 + np.exp(-(values @ self.weights[at] + self.bias))))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the queries take them; the same as url_parts."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def grams(host: str, path: str, buckets: int, sizes: Sequence[int] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of host and path, each with its own salt: buckets and values of unit length."""
    seen = []
    for salt, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            seen.extend(zlib.crc32(f"{salt}{text[i : i + n]}".encode("utf-8", "replace")) % buckets for i in range(max(1, len(text) - n + 1)))
    at, counts = np.unique(np.array(seen, dtype=np.int64), return_counts=True)
    values = np.log1p(counts)
    return at, values / np.sqrt((values**2).sum())


def train_url_model(labelled: Sequence[tuple[str, int]] = LABELLED_URLS, buckets: int = 1 << 14, l2: float = 1e-3, rounds: int = 400, rate: float = 4.0) -> UrlModel:
    """Logistic regression by full gradient steps on the driver; the labelled table is small."""
    x = np.zeros((len(labelled), buckets))
    for row, (url, _) in enumerate(labelled):
        at, values = grams(*split_url(url), buckets)
        x[row, at] = values
    y = np.array([label for _, label in labelled], dtype=float)
    used = np.flatnonzero(x.any(axis=0))
    x, w, b = x[:, used], np.zeros(len(used)), 0.0
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ gap / max(1, len(y)) + l2 * w)
        b -= rate * gap.mean() if len(y) else 0
    weights = np.zeros(buckets)
    weights[used] = w
    return UrlModel(weights, float(b))


def url_parts(url: str) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """Adds host, path, rule, score and verdict to every row.

    The longest rule that fits decides (of equal length, the first listed); else `block`
    where the model's score reaches the threshold. score is null where a rule decides. Null
    urls, and those without `://`, have empty host and path and are judged by the model on
    these. Every row is judged by itself and by its whole url, so repeated rows and ids come
    out alike; an empty table gives an empty one. Where a column of the table has an added
    column's name, the added one gets underscores behind it (shared.added_name). Rules and
    weights go to the executors; both are small tables by their nature.
    """
    names = [added_name(pages.columns, n) for n in ("host", "path", "rule", "score", "verdict")]
    host_at, path_at, rule_at, score_at, verdict_at = names
    host, path = url_parts(url)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((F.col(host_at) == r.host) | F.col(host_at).endswith("." + r.host)) & F.col(path_at).startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    split = pages.withColumns({host_at: host, path_at: path}).withColumns({rule_at: rule, verdict_at: verdict})
    schema = T.StructType([*split.schema.fields[:-1], T.StructField(score_at, T.DoubleType()), split.schema[verdict_at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(*(batch.column(c).to_pylist() for c in (host_at, path_at, verdict_at)), strict=True)
            scores = [(None if v else model.score(h, p), v) for h, p, v in parts]
            new = [pa.array([s for s, _ in scores], pa.float64()), pa.array([v or ("block" if s >= threshold else "allow") for s, v in scores], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return split.mapInArrow(run, schema)
