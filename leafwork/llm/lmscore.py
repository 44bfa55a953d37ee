"""Language-model scores from a subword lattice.

A fixed public vocabulary gives the pieces; their unigram scores are relative frequencies over all training
words, sharpened by rounds of expectation-maximisation over all segmentations.  A text's probability is the sum over all its segmentations.  No piece crosses from one word into the
next, so that sum is a product over words, and the forward recursion, in log space, runs once per distinct word
of the corpus.  Frequent words, a bounded number, travel to the documents; the rest meet their documents in a join.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, cut

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
_ln10 = math.log(10)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def held_out(doc_id):
    return crc_of_id(doc_id) % 10 == 0


class Lattice:
    """Natural-log piece scores as a trie of characters, and scores of single bytes for characters without a piece."""

    def __init__(self, pieces: dict[str, float], single: list[float]):
        self.trie: dict = {}
        for piece, score in pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.single = single

    def log_probability(self, word: str) -> float:
        """Log of the summed probability of all segmentations of START + word."""
        text = START + word
        n = len(text)
        forward = [-math.inf] * n + [-math.inf]
        forward[0] = 0.0
        log1p, exp, inf, trie = math.log1p, math.exp, math.inf, self.trie
        for i in range(n):
            here, node, j = forward[i], trie, i
            if here == -inf:
                continue
            alone = False
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                score = node.get("")
                if score is not None:
                    alone = alone or j == i + 1
                    new, old = here + score, forward[j]
                    if old == -inf:
                        forward[j] = new
                    elif new > old:
                        forward[j] = new + log1p(exp(old - new))
                    else:
                        forward[j] = old + log1p(exp(new - old))
            if not alone:  # byte fallback
                new = here + sum(self.single[b] for b in text[i].encode())
                old = forward[i + 1]
                top = max(new, old)
                forward[i + 1] = new if old == -inf else top + log1p(exp(min(new, old) - top))
        return forward[n]

    def expected(self, word: str, times: int, into: dict) -> bool:
        """Add the expected uses of each piece in ``times`` copies of a word; False if they are too small for floats.

        Forward and backward sums are scaled by one factor per character, which cancels.
        """
        text = START + word
        n = len(text)
        lift = 2.5 if n < 64 else -self.log_probability(word) / n
        f, edges = [0.0] * (n + 1), []
        f[0] = 1.0
        for i in range(n):
            node, j, alone, here = self.trie, i, False, f[i]
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                score = node.get("")
                if score is not None:
                    alone = alone or j == i + 1
                    p = math.exp(score + lift * (j - i))
                    f[j] += here * p
                    edges.append((i, j, p, text[i:j]))
            if not alone:
                p = math.exp(sum(self.single[b] for b in text[i].encode()) + lift)
                f[i + 1] += here * p
                edges.append((i, i + 1, p, text[i].encode()))
        if not 0 < f[n] < math.inf:
            return False
        b = [0.0] * n + [times / f[n]]
        for i, j, p, piece in reversed(edges):
            part = p * b[j]
            b[i] += part
            part *= f[i]
            if isinstance(piece, bytes):
                for x in piece:
                    into[x] = into.get(x, 0.0) + part
            else:
                into[piece] = into.get(piece, 0.0) + part
        return True


def word_counts(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """Rows (word, c): uses of each word in training documents; 0 for words of held-out documents only.

    Each task adds up at most ``limit`` words before it sends them on.
    """

    def run(batches):
        seen: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for text, out in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                if out:
                    for w in set(words):
                        seen.setdefault(w, 0)
                else:
                    seen.update(words)
                if len(seen) >= limit:
                    yield sent()
                    seen.clear()
        if seen:
            yield sent()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(lexicon: DataFrame, model: bytes, scores=None) -> list[tuple[int, float]]:
    """(piece id, uses) over all training words: at most one row per piece of the vocabulary.

    Uses are those of the vocabulary's own segmentation or, given scores, those expected over all segmentations.
    """

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        lattice = scores and Lattice(*scores.value)
        total: dict = {}
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                word = w.decode("utf-8", "replace")
                if not (lattice and lattice.expected(word, n, total)):
                    for i in sp.encode(word):
                        total[sp.id_to_piece(i)] = total.get(sp.id_to_piece(i), 0.0) + n
        if total:
            ids = [sp.piece_to_id(x if isinstance(x, str) else f"<0x{x:02X}>") for x in total]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(list(total.values()), pa.float64())], ["piece", "n"])

    rows = lexicon.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    return list(zip(rows["piece"].to_pylist(), rows["n"].to_pylist()))


def piece_scores(model: bytes, uses: list[tuple[int, float]], ends: int, smooth: float = 0.1) -> tuple[dict[str, float], list[float], float]:
    """Log probabilities of pieces, of single bytes and of the end of a text; together they sum to one."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = [0.0] * sp.get_piece_size()
    for i, c in uses:
        n[i] += c
    normal = [i for i in range(len(n)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = math.log(sum(n[i] for i in normal) + ends + smooth * (len(normal) + 1))
    score = {i: math.log(n[i] + smooth) - total for i in normal}
    single = [-math.inf] * 256
    for i in normal:
        if sp.is_byte(i):
            single[int(sp.id_to_piece(i)[1:-1], 16)] = score[i]
    pieces = {sp.id_to_piece(i): s for i, s in score.items() if not sp.is_byte(i)}
    return pieces, single, math.log(ends + smooth) - total


def score(docs: DataFrame, vocabulary: str = VOCABULARY, hot_words: int = 65_536, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Tokens are the words, A-Z lowered, and one end.  A null text counts as empty: one token, the end.  A null id
    counts as the empty text when the rows are split.  Repeated rows count each time.  At most ``hot_words``
    words are broadcast, the most frequent; all others are joined.  Without training rows no word is known.  Words that
    are not UTF-8 are counted as bytes and scored with replacement characters.  An empty table gives no rows; columns other
    than the two read are ignored.
    """
    with open(vocabulary, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    counted = cut(word_counts(rows))
    tokens, distinct = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.where("not held_out").count()
    total, kinds = tokens + ends, distinct + (ends > 0)
    size = math.log10(total + 0.1 * (kinds + 1))
    pieces, single, end_score = piece_scores(model, piece_counts(counted, model), ends)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, single))
    for _ in range(rounds):
        pieces, single, end_score = piece_scores(model, piece_counts(counted, model, sent), ends)
        sent = docs.sparkSession.sparkContext.broadcast((pieces, single))

    def weigh(batches):
        lattice = Lattice(*sent.value)
        for b in batches:
            lp = [lattice.log_probability(w.decode("utf-8", "replace")) / _ln10 for w in b.column(0).to_pylist()]
            base = [math.log10(c + 0.1) - size for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.float64()), pa.array(lp, pa.float64())], ["word", "c", "base", "lp"])

    lexicon = cut(counted.mapInArrow(weigh, "word binary, c long, base double, lp double"))
    hot = lexicon.orderBy(F.desc("c"), "word").limit(hot_words).toArrow()
    known = dict(zip(hot["word"].to_pylist(), zip(hot["c"].to_pylist(), hot["base"].to_pylist(), hot["lp"].to_pylist())))
    known_sent = docs.sparkSession.sparkContext.broadcast(known)
    end_row = (int(ends > 0), math.log10(ends + 0.1) - size, end_score / _ln10)
    rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def add_up(batches):
        get = known_sent.value.get
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                n_known, base, lp = end_row
                n, rest = 1, []
                for w, k in Counter(words_of(text)).items():
                    n += k
                    got = get(w)
                    if got is None:
                        rest.append({"word": w, "n": k})
                    else:
                        base += k * got[1]
                        lp += k * got[2]
                        if got[0]:
                            n_known += k
                out.append((n, n_known, base, lp, rest))
            n, n_known, base, lp, rest = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(lp, pa.float64()), pa.array(rest, rest_type)],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"],
            )

    summed = cut(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(add_up, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, n: long>>"))
    rare = summed.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n").join(lexicon, "word")
    rare = rare.groupBy("row").agg(F.sum(F.expr("if(c > 0, n, 0)")).alias("k"), F.sum(F.expr("n * base")).alias("b"), F.sum(F.expr("n * lp")).alias("l"))
    out = summed.drop("rest").join(rare, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "l"))
