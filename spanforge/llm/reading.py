"""Level of reading difficulty of the author's own prose of forum posts.

Posts are reduced to the author's prose (quotes, signatures, notes, code, links and markup go). Every word and mark of
it has features of vocabulary (length, learned endings, hashed form) and of syntax (subordinators, learned connectives,
personal pronouns, marks inside and at the end of sentences). A linear pairwise ranker is fitted by least squares on
all pairs of labelled posts of different bands: the sums over the pairs follow from counts, sums and second moments
per band, so no pair is ever formed, no label is left out, and partitions add up. Scores become levels by isotonic
regression on scores of posts that the ranker had not seen (FOLDS folds).

The score of a post is the median over its sentences, so that an odd sentence does not count; text without full stops
is cut every WINDOW words.

Defined results: a post of less than MIN_WORDS words of prose, or mostly in another language than English, German,
French or Spanish, has no level; null texts and nulls in labels are no values; without labels of two bands no post has a
level; a post labelled several times counts once, shared between its bands.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import materialize

MIN_WORDS, WINDOW, MAX_SENTENCE = 25, 12, 45
BUCKETS, FOLDS, BINS = 384, 3, 2048
#: Ridge, as a share of the mean variance of a feature, and in labelled posts.
RIDGE = 4.0
BANDS = (1, 2, 3)
_CACHE = 200_000

# ---- prose ----

_NEST = re.compile(r"(?i)(\[/quote\]|</blockquote>)|(\[quote\b[^\]\n]*\]|<blockquote\b[^>]*>)")
_BLOCKS = re.compile(r"(?is)\[code\b[^\]]*\].*?(?:\[/code\]|\Z)|<(pre|code|script|style)\b[^>]*>.*?(?:</\1>|\Z)|^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)", re.M)
_BREAK = re.compile(r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|hr|/?h\d)\b[^>]*>")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|\[/?(?:b|i|u|s|url|img|color|size|list|font|center|spoiler|\*)(?:=[^\]\n]*)?\]|\[(?:img|url)[^\]\n]*\]", re.I)
_LINK = re.compile(r"(?i)\b(?:https?://|ftp://|www\.)\S+")
_QUOTE_LINE = re.compile(r"\s*(?:>|\||: |:$)")
_HEAD = re.compile(r"(?i)\s*(?:(?:\S+|(?:on|am|le|el)\b.{0,60}) (?:wrote|schrieb|a écrit|escribió)\b.{0,40}:|quoting \S+:|-{3,} ?original (?:post|message).*|@\S+|[\w.-]+>)\s*$")
_SIGNATURE = re.compile(r"\s*(?:--|_{3,}|\*{3,}|-{3,}|={3,}|~{3,})\s*$")
_NOTE = re.compile(r"(?i)\s*(?:\[?(?:edited by|edit:|last edited|removed by|deleted)\b.*|\[deleted\]|sent from my .*|setup: .*|my pics:.*|.*\|.*\bmember since\b.*|~ \S+ ~|.*[.!?\"] [-–—] ?[a-z]+[a-z0-9_]*)\s*$")
_CODE = re.compile(r"\s*(?:\$ |>>> |at \S+:\d+|ERROR\b.*0x|(?:for|if|while|def|class)\b.*:\s*$|print\(|SELECT\b.*\bFROM\b|[{}<\[].*[}>\]];?\s*$|chr\w+\t|#include\b|import \w+\s*$|\S*_\S*\s*$|.*;\s*$)")
_PUNCT = re.compile(r"[^\w\s.,!?'\"*:-]|_")
_MOJIBAKE = re.compile(r"[ÃÂâ][\x80-\xbf€-™¡-¿ŠšŒœŽžŸƒˆ˜–—‘-„†-•…‰‹›]")


def _outside(text: str) -> str:
    """The text that is in no quote of brackets or tags. A quote that is never closed ends with its paragraph."""
    opened: list[int] = []
    cuts, partner = [], {}
    for m in _NEST.finditer(text):
        if m[2]:
            opened.append(m.start())
        elif opened:
            partner[opened.pop()] = m.end()
    for start in opened:
        end = text.find("\n\n", start)
        partner[start] = len(text) if end < 0 else end
    out, at = [], 0
    for start in sorted(partner):
        cuts.append((start, partner[start]))
    for start, end in cuts:
        if start >= at:
            out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    return "\n".join(out)


def _repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read rightly, piece by piece."""
    def fix(m: re.Match) -> str:
        for enc in ("cp1252", "latin-1"):
            try:
                return m[0].encode(enc).decode("utf-8")
            except UnicodeError:
                pass
        return m[0]

    return re.sub(r"[\x80-\xffŠšŒœŽžŸƒˆ˜–—‘-„†-•…‰‹›€™]{2,}", fix, text)


def prose(text: str | None) -> str:
    """The author's own prose of a post: no quotes, signatures, notes, code, links and markup."""
    if not text:
        return ""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if _MOJIBAKE.search(t):
        t = _repaired(t)
    if "[" in t or "<" in t or "```" in t:
        t = _BLOCKS.sub("\n", t)
        t = _BREAK.sub("\n", _outside(t))
        t = _TAG.sub("", t)
    if "&" in t:
        t = html.unescape(html.unescape(t))
    t = t.replace(" ", " ").replace("　", " ").replace("﻿", "").replace("​", "").replace("­", "").replace("’", "'")
    lines = t.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    for i in full[::-1][:6]:  # a signature is short and stands last
        if _SIGNATURE.match(lines[i]) and i != full[0]:
            lines = lines[:i]
            break
    out = []
    for x in lines:
        if not x or x.isspace():
            out.append("")
        elif _QUOTE_LINE.match(x) or _HEAD.match(x) or _NOTE.match(x) or _CODE.match(x):
            continue
        else:
            x = _LINK.sub(" ", x)
            if len(_PUNCT.findall(x)) * 6 <= len(x):
                out.append(x)
    return "\n".join(out).strip()


# ---- words ----

_TOKEN = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*|[.!?]+|[,;:()]|\n\s*\n|\d+")
_FOREIGN = re.compile(r"[Ͱ-᳿⺀-퟿豈-﫿]")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


#: Frequent words; the last entry are those of other languages in Latin script that the four don't have.
_COMMON = {
    "en": _set("the a an of and to in is it that was for on with as by be this not or are from at which but have had has my your his he she they we you i do does did its so"),
    "de": _set("der die das und ist ich nicht ein eine einen dem den des zu mit auf für von war sich auch es hat er sie wo im als so wie aus noch nur dass deine meine mein"),
    "fr": _set("le la les des et est un une que qui dans pour pas sur il je du au aux ce cette mon ton ma avec plus par en elle nous vous à a mais ne toute"),
    "es": _set("el la los las y es un una que en de no se por con para mi tu su del al hay yo lo como más pero ha he está sí toda"),
    "other": _set("il che di non per una sono della gli nel het een van niet zijn dat op voor met não uma os do da em och att det som är jag på nie się jest og ikke til på hij ik ze com mais seu sua"),
}
_SUBORD = _set("that which whose whom whereby wherein although though albeit insofar unless whether because since when while after before if until than rather nor neither either whereas lest dass weil obwohl sofern indem insofern wenn wo als deren dessen ob während nachdem que qui dont lorsque bien quand parce si où puisque quoique aunque cuyo cuya cuyos cuyas porque cuando si mientras donde según")
_LEARNED = _set("notwithstanding pursuant thereby thus hence consequently moreover nevertheless nonetheless therefore whereas upon insofar albeit former latter such merely qua rendering itself themselves wherein hereby thereof being exclusively inevitably would should were ungeachtet hinsichtlich mithin vielmehr seinerseits jenes jener kraft gleichwohl lediglich sofern insofern demnach zugleich bezüglich nonobstant ainsi toutefois néanmoins exclusivement mesure lequel laquelle quelconque demeure celle celui obstante asimismo mediante dicho dicha exclusivamente medida ello cual toda resulta sino")
_PERSON = _set("i you he she we they me him us them my your his her our their mine ich du er sie wir ihr mich dich mein meine meinen dein deine deinen je tu il elle nous vous j'ai mon ton ma ta mes tes yo tú él ella nosotros mi tu mis tus he has")
_ENDINGS = re.compile(r"(?:[st]ions?|it(?:y|ies)|isms?|ists?|olog\w+|is(?:es|ed|ing|ations?)|iz(?:es|ed|ing|ations?)|ances?|ences?|istic|ical|ically|ive|ous|ment|ität(?:en)?|ierung(?:en)?|ung(?:en)?|keit|heit|lich\w*|isch\w*|ités?|ismes?|ique\w*|ement|dad(?:es)?|ción|ciones|ismos?|mente|ic[oa]s?)$")
LENGTHS, CLASSES = 6, 10
D = LENGTHS + CLASSES + BUCKETS
_END, _INNER, _SUB, _LRN, _PRS, _LNG, _NUM, _COM = (LENGTHS + i for i in range(8))


def features(token: str) -> tuple[int, ...]:
    """Numbers of the features of a word or mark."""
    if token.isdigit():
        return (_NUM,)
    if token[0] in ".!?":
        return (_END,)
    if not token[0].isalpha():
        return (_INNER,)
    n = len(token)
    out = [0 if n < 3 else 1 if n < 5 else 2 if n < 7 else 3 if n < 10 else 4 if n < 13 else 5]
    for words, f in ((_SUBORD, _SUB), (_LEARNED, _LRN), (_PERSON, _PRS)):
        if token in words:
            out.append(f)
    if n > 6 and _ENDINGS.search(token):
        out.append(_LNG)
    if any(token in w for w in _COMMON.values()):
        out.append(_COM)
    out.append(LENGTHS + CLASSES + zlib.crc32(token.encode()) % BUCKETS)
    return tuple(out)


def sentences(text: str) -> list[list[str]]:
    """Words and marks of each sentence; pieces of less than 3 words join the one before, long ones are cut."""
    out: list[list[str]] = []
    now: list[str] = []
    words = 0

    def close() -> None:
        nonlocal now, words
        if words < 3 and out:
            out[-1] += now
        elif words > MAX_SENTENCE:
            out.extend(now[i : i + WINDOW] for i in range(0, len(now), WINDOW))
        elif now:
            out.append(now)
        now, words = [], 0

    for t in _TOKEN.findall(text.lower()):
        if t[0] == "\n":
            close()
        elif t[0] in ".!?":
            now.append(t)
            close()
        else:
            now.append(t)
            words += t[0].isalpha()
    close()
    return out


def own_prose(text: str | None) -> str | None:
    """The prose of a post if it is one that has a level."""
    p = prose(text)
    words = [w for w in _TOKEN.findall(p.lower()) if w[0].isalpha()]
    if len(words) < MIN_WORDS or 2 * len(_FOREIGN.findall(p)) > sum(map(len, words)):
        return None
    hits = {k: sum(w in v for w in words) for k, v in _COMMON.items()}
    other = hits.pop("other")
    return p if max(hits.values()) >= max(other, 1) else None


# ---- ranker ----


def vector(text: str) -> np.ndarray:
    """Mean over the sentences of the features per token."""
    s = sentences(text)
    x = np.zeros(D)
    for tokens in s:
        ids = [f for t in tokens for f in features(t)]
        x += np.bincount(ids, minlength=D) / len(tokens)
    return x / max(len(s), 1)


class Scorer:
    """Median over the sentences of the mean weight of their tokens."""

    def __init__(self, w: np.ndarray, offset: float) -> None:
        self.w, self.offset, self.known = w, offset, {}

    def __call__(self, text: str) -> float:
        known, means = self.known, []
        for tokens in sentences(text):
            total = 0.0
            for t in tokens:
                v = known.get(t)
                if v is None:
                    if len(known) >= _CACHE:
                        known.clear()
                    v = known[t] = float(sum(self.w[f] for f in features(t)))
                total += v
            means.append(total / len(tokens))
        return float(np.median(means)) - self.offset if means else 0.0


def moments(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Count, sum and second moments of rows, in one array of D + 1 columns that adds up over parts."""
    one = np.hstack([np.ones((len(x), 1)), x])
    return one.T @ (one * weight[:, None])


def fit(by_band: dict[int, np.ndarray]) -> tuple[np.ndarray, float] | None:
    """(weights, offset) of the least squares on all pairs of rows of different bands; None if there is no pair."""
    a, rhs, pairs = np.zeros((D, D)), np.zeros(D), 0.0
    for hi in by_band:
        for lo in by_band:
            if hi > lo:
                mh, ml = by_band[hi], by_band[lo]
                nh, nl, sh, sl = mh[0, 0], ml[0, 0], mh[0, 1:], ml[0, 1:]
                a += nl * mh[1:, 1:] + nh * ml[1:, 1:] - np.outer(sh, sl) - np.outer(sl, sh)
                rhs += (hi - lo) * (nl * sh - nh * sl)
                pairs += nh * nl
    if not pairs:
        return None
    total = sum(by_band.values())
    variance = np.trace(a) / D / pairs
    ridge = RIDGE * variance * pairs / max(total[0, 0], 1) ** 0.5
    w = np.linalg.solve(a + ridge * np.eye(D), rhs)
    return w, float(w @ total[0, 1:] / total[0, 0])


def isotonic(score: np.ndarray, weight: np.ndarray, band_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing levels by pooling adjacent violators: (mean score of each pool, its level). Between them levels are interpolated."""
    blocks: list[tuple[float, float, float]] = []
    for i in np.argsort(score, kind="stable"):
        blocks.append((weight[i], band_sum[i], weight[i] * score[i]))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = tuple(x + y for x, y in zip(blocks[-1], last, strict=True))
    return np.array([m / w for w, _, m in blocks]), np.array([s / w for w, s, _ in blocks])


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, fold, prose, bands (map of band to share) of the labelled posts that have a level."""
    share = labels.where(F.col("doc_id").isNotNull() & F.col("band").isin(*BANDS)).groupBy("doc_id").agg(*[F.avg((F.col("band") == b).cast("double")).alias(f"b{b}") for b in BANDS])
    posts = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(share, "doc_id")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["prose"] = pdf.pop("text").map(own_prose)
            yield pdf[pdf["prose"].notna()]

    # not a udf with a filter, which would be pushed below the join and run over all posts
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return materialize(posts.select("doc_id", fold, "text", *[f"b{b}" for b in BANDS]).mapInPandas(own, "doc_id bigint, fold int, prose string, " + ", ".join(f"b{b} double" for b in BANDS)))


def _moments(labelled: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Moments per fold and band, added up in two steps outside the driver; of the symmetric matrices one half is sent."""
    half = np.triu_indices(D + 1)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                p = pdf.iloc[i : i + 2000]
                x = np.array([vector(t) for t in p["prose"]])
                for fold in p["fold"].unique():
                    for b in BANDS:
                        at = ((p["fold"] == fold) & (p[f"b{b}"] > 0)).to_numpy()
                        if at.any():
                            m = moments(x[at], p[f"b{b}"].to_numpy()[at])
                            sums[fold, b] = sums.get((fold, b), 0) + m
        yield pd.DataFrame([(int(f), b, m[half].tobytes()) for (f, b), m in sums.items()], columns=["fold", "band", "m"])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(half[0]))
        for m in parts["m"]:
            total += np.frombuffer(m)
        return pd.DataFrame([(*key, total.tobytes())], columns=["fold", "band", "m"])

    schema = "fold int, band int, m binary"
    # a task sends one matrix per fold and band, so their number is bounded; FOLDS * 3 matrices come to the driver
    rows = labelled.coalesce(48).mapInPandas(part, schema).groupBy("fold", "band").applyInPandas(add, schema).collect()
    out = {}
    for r in rows:
        m = np.zeros((D + 1, D + 1))
        m[half] = np.frombuffer(bytes(r["m"]))
        out[r["fold"], r["band"]] = m + np.triu(m, 1).T
    return out


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, level (1 to 3, with fractions), band of every post that has one."""
    schema = "doc_id bigint, level double, band int"
    labelled = _labelled(documents, labels)
    m = _moments(labelled)
    every = fit(_bands(m, None))
    if every is None:
        return documents.sparkSession.createDataFrame([], schema)
    unseen = {f: fit(_bands(m, f)) or every for f in range(FOLDS)}

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = {f: Scorer(*u) for f, u in unseen.items()}
        for pdf in batches:
            s = [scorers[f](t) for f, t in zip(pdf["fold"], pdf["prose"], strict=True)]
            yield pd.DataFrame({"bin": np.clip(np.rint(np.array(s) * BINS / 8), -BINS, BINS).astype(int), "band": sum(b * pdf[f"b{b}"] for b in BANDS)})

    bins = labelled.mapInPandas(held_out, "bin int, band double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("band").alias("s")).toPandas()  # at most 2 * BINS + 1 rows
    at, level = isotonic(bins["bin"].to_numpy() * 8 / BINS, bins["n"].to_numpy(float), bins["s"].to_numpy())

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(*every)
        for pdf in batches:
            rows = [(i, score(p)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) if (p := own_prose(t)) is not None]
            lv = np.interp([s for _, s in rows], at, level)
            yield pd.DataFrame({"doc_id": [i for i, _ in rows], "level": lv, "band": np.floor(lv + 0.5).astype(int)})

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(apply, schema)


def _bands(m: dict[tuple[int, int], np.ndarray], without: int | None) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for (fold, band), x in m.items():
        if fold != without:
            out[band] = out.get(band, 0) + x
    return out
