"""Language-model scoring over an Elias-Fano n-gram trie.

Tokens are lower-cased words and one end per text.  The model is a trigram
that merges counts of three orders; every probability sums to one:

    p(w | v u) = (c(v, u, w) + A (c(u, w) + M p1(w))) / (c(v, u) + A (c(u) + M))
    p1(w) = (c(w) + 1) / (N + V + 1)

The trie is stored by predicted word: level 1 has the words, level 2 the word
before each, level 3 the one before that.  So a word's counts, its back-off and
all its n-grams lie in one shard, and the numerator and denominator are
separate sums: w adds the logarithm of the numerator where it is predicted and,
as the context of the next token, minus that of c(u, w) + A (c(w) + M).  Both
are quantised to 1/1024 of a log10 unit.  Contexts are hashes of 36 bits under
their word and 28 bits under their pair.  A trie lives in an anonymous memory
map of the task that builds it, as executors share no folder that can be mapped
everywhere.

Plan.  Pass 1 counts words of the training texts (pre-aggregated by block) and
yields N, V and the frequent words: those above text bytes / 8192 occurrences,
at most 8192 of them since each occurrence takes a byte at least.  Pass 2 deals
the tokens of all texts by hash of the word into shards, packed at about 10
bytes a token; a frequent word is dealt by the hash of word and context
instead, its count being known, so no shard grows with the share of a word.  Each shard builds its
trie, looks up its distinct trigrams, and answers every block with a sum per
document; blocks add up their shards.  A block is addressed by its partition,
number and content, and knows how many shards must answer: where a lost
executor's rows come back in another order (``docs`` after a shuffle), the job
fails rather than mix scores; a file scan repeats alike.

Cases: a null or empty text has one token, its end; a null id is held out and
scored; equal rows get equal scores; without training texts p is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privtab.llm import common as C
from privtab.llm.eliasfano import FAR_BITS, Trie

#: Weight M of the prior, and weight A of a bigram's count beside a trigram's (the best
#: of nine settings on texts held out of the training texts).
PRIOR = 1000.0
MERGE = 0.003
STEP = 1024
LEAST_SHARDS = 64
FREQUENT = 8192

_START = np.uint64(xxhash.xxh3_64_intdigest(b"\n<start>"))
_END = np.uint64(xxhash.xxh3_64_intdigest(b"\n<end>"))
_FAR = np.uint64(FAR_BITS)
_LOW = np.uint64((1 << FAR_BITS) - 1)


def _tokens(counts: np.ndarray, hashes: np.ndarray):
    """Words and one end per document: (counts + 1, predicted tokens)."""
    sizes = counts + 1
    out = np.empty(int(sizes.sum()), np.uint64)
    ends = np.cumsum(sizes) - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = hashes
    out[ends] = _END
    return sizes, out


def _word_counts(batches):
    for _, counts, hashes in C.token_blocks(batches, C.words_lower):
        values, n = np.unique(hashes, return_counts=True)
        values, n = np.r_[values, _END], np.r_[n, len(counts)]
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])


_REQUEST = "shard int, block long, kind int, words binary, runs binary, contexts binary, docs binary"
_ANSWER = "block long, kind int, docs binary, base binary, model binary, known binary"


def _batch(rows, names_types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), names_types)],
                                      names=[n for n, _ in names_types])


_REQUEST_ARROW = [("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("words", pa.binary()),
                  ("runs", pa.binary()), ("contexts", pa.binary()), ("docs", pa.binary())]
_ANSWER_ARROW = [("block", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("base", pa.binary()),
                 ("model", pa.binary()), ("known", pa.binary())]


def _requests(shards: int, frequent: np.ndarray):
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, ((ids, no_id, held), counts, hashes) in enumerate(
                C.token_blocks(batches, C.words_lower, columns=("doc_id", "no_id", "held_out"))):
            sizes, words = _tokens(counts, hashes)
            block = xxhash.xxh3_64_intdigest(words.tobytes() + ids.tobytes(), part << 32 | number) >> 1
            starts = np.cumsum(sizes) - sizes
            # hash of the word before and, below it, of the one before that
            near = np.empty_like(words)
            near[1:] = words[:-1]
            near[starts] = _START
            near = C.mix(near)
            far = np.empty_like(near)
            far[1:] = near[:-1]
            far[starts] = near[starts]
            far >>= np.uint64(64 - FAR_BITS)
            near >>= _FAR
            context = near << _FAR | far
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            shard = (words >> shift).astype(np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
                hot = frequent[at] == words
                shard[hot] = C.mix(words[hot] ^ near[hot]) >> shift
            order = np.lexsort((words, shard))
            words, context, doc, shard = words[order], context[order], doc[order], shard[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            flags = C.squeeze(np.asarray(held, np.uint8))
            # the roster goes along with the answers, of which it knows the number
            rows = [(int(block % shards), block, 0, C.squeeze(C.deltas(np.asarray(ids, np.int64))),
                     C.squeeze(np.r_[len(cuts), sizes].astype(np.int64)), C.squeeze(np.asarray(no_id, np.uint8)), flags)]
            for a, b in zip(cuts, np.r_[cuts[1:], len(shard)]):
                w = words[a:b]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                rows.append((int(shard[a]), block, 1, C.squeeze(w[first]),
                             C.squeeze(np.diff(np.r_[first, b - a]).astype(np.uint32)),
                             C.squeeze(context[a:b]), C.squeeze(C.deltas(doc[a:b]))))
            # and to each shard: which documents of the block are held out
            rows += [(int(s), block, 2, flags, None, None, None) for s in np.unique(shard)]
            yield _batch(rows, _REQUEST_ARROW)

    return run


def _shard(total: int, distinct: int, frequent: np.ndarray, frequent_n: np.ndarray, prior: float, merge: float):
    """One shard: build its trie from the training tokens, look all tokens up."""
    scale = total + distinct + 1

    def grid(x):
        return np.rint(np.log10(x) * STEP).astype(np.int16)

    def trie_of(words, contexts, met):
        """From the (sorted) training trigrams of the shard; a frequent word
        that the shard has ``met`` is known though its n-grams may lie elsewhere."""
        new_word, new_pair, new = _changes(words, contexts)
        first, pairs, heads = (np.flatnonzero(x) for x in (new, new_pair, new_word))
        c3, c2, c1 = (np.diff(np.r_[x, len(words)]) for x in (first, pairs, heads))
        own = words[heads]
        every = np.union1d(own, np.intersect1d(frequent, met))
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, own)] = c1
        if len(frequent) and len(every):
            at = np.minimum(np.searchsorted(frequent, every), len(frequent) - 1)
            counts = np.where(frequent[at] == every, frequent_n[at], counts)
        of_word = np.searchsorted(every, words[pairs])
        of_pair = np.cumsum(new_pair[first]) - 1
        back = merge * prior * (counts + 1) / scale
        weight = merge * (counts + prior)
        back2 = merge * c2 + back[of_word]
        return Trie.build(every, counts, of_word, contexts[pairs] >> _FAR, of_pair, contexts[first] & _LOW,
                          grid(back), grid(weight), grid(back2), grid(c2 + weight[of_word]), grid(c3 + back2[of_pair]))

    def run(table: pa.Table) -> pa.Table:
        out, flags, asked = [], {}, []
        for r in table.to_pylist():
            if r["kind"] == 0:
                out.append((r["block"], 0, r["words"], r["runs"], r["contexts"], r["docs"]))
            elif r["kind"] == 2:
                flags[r["block"]] = C.unsqueeze(r["words"], np.uint8).astype(bool)
            else:
                asked.append(r)
        if asked:
            words = np.concatenate([np.repeat(C.unsqueeze(r["words"], np.uint64), C.unsqueeze(r["runs"], np.uint32))
                                    for r in asked])
            contexts = np.concatenate([C.unsqueeze(r["contexts"], np.uint64) for r in asked])
            docs = [C.undelta(C.unsqueeze(r["docs"], np.uint32)) for r in asked]
            train = np.concatenate([~flags[r["block"]][d] for r, d in zip(asked, docs)])
            order = np.lexsort((contexts, words))
            words, contexts, train = words[order], contexts[order], train[order]
            trie = trie_of(words[train], contexts[train], words).mapped()
            new_word, new_pair, new = _changes(words, contexts)
            # each level once per distinct n-gram, found below its parent's place
            first, pairs = np.flatnonzero(new), np.flatnonzero(new_pair)
            w = words[new_word]
            place = trie.words.find(w)
            count = _pick(trie.counts, place, 0)
            model = _pick(trie.backoff, place, grid(merge * prior / scale))
            weight = _pick(trie.weight, place, grid(merge * prior))
            of = np.cumsum(new_word[pairs]) - 1
            place = trie.near.find(place[of], contexts[pairs] >> _FAR)
            model, weight = _pick(trie.backoff2, place, model[of]), _pick(trie.weight2, place, weight[of])
            # an end is the context of nothing
            weight[w[of] == _END] = 0
            pair = np.cumsum(new_pair[first]) - 1
            place = trie.far.find(place[pair], contexts[first] & _LOW)
            model = _pick(trie.prob, place, model[pair]) - weight[pair]
            count = count[of][pair]
            base = np.log10(count + 1.0)
            # back to the order of the requests
            group = np.empty(len(words), np.int64)
            group[order] = np.cumsum(new) - 1
            at = 0
            for r, d in zip(asked, docs):
                g = group[at:at + len(d)]
                at += len(d)
                size = int(d.max()) + 1
                some = np.flatnonzero(np.bincount(d, minlength=size))
                out.append((r["block"], 1, C.squeeze(C.deltas(some.astype(np.uint32))),
                            C.squeeze(np.bincount(d, base[g], size)[some]),
                            C.squeeze(np.bincount(d, model[g], size)[some].astype(np.int32)),
                            C.squeeze(np.bincount(d, count[g] > 0, size)[some].astype(np.uint32))))
        columns = list(zip(*out)) if out else [()] * len(_ANSWER_ARROW)
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ANSWER_ARROW)],
                                    names=[n for n, _ in _ANSWER_ARROW])

    return run


def _changes(words, contexts):
    """Where a new word, pair and trigram starts in sorted tokens."""
    def new(x):
        return np.r_[True, x[1:] != x[:-1]][:len(x)]

    word = new(words)
    pair = word | new(contexts >> _FAR)
    return word, pair, pair | new(contexts)


def _pick(values, place, otherwise):
    """Values at their places, or something else where the place is -1."""
    out = np.full(len(place), otherwise, np.int64)
    out[place >= 0] = values[place[place >= 0]]
    return out


_RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


def _finish(total: int, distinct: int, texts: int, prior: float, merge: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        roster = next((r for r in rows if r["kind"] == 0), None)
        if roster is None or len(rows) - 1 != C.unsqueeze(roster["base"], np.int64)[0]:
            raise RuntimeError("a rerun task read other rows than before: write the documents to a table first")
        ids = C.undelta(C.unsqueeze(roster["docs"], np.int64))
        sizes = C.unsqueeze(roster["base"], np.int64)[1:]
        no_id = C.unsqueeze(roster["model"], np.uint8).astype(bool)
        held = C.unsqueeze(roster["known"], np.uint8).astype(bool)
        base, model, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        # in a fixed order, so that sums of doubles do not depend on arrival
        for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["base"]):
            at = C.undelta(C.unsqueeze(r["docs"], np.uint32))
            base[at] += C.unsqueeze(r["base"], np.float64)
            model[at] += C.unsqueeze(r["model"], np.int32)
            known[at] += C.unsqueeze(r["known"], np.uint32)
        base -= sizes * np.log10(total + distinct + 1.0)
        score = model / STEP - np.log10(texts + merge * (texts + prior))
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64(), mask=no_id), pa.array(held), pa.array(sizes), pa.array(known),
             pa.array(np.full(len(ids), total), pa.int64()), pa.array(base), pa.array(score)],
            names=[f.split()[0] for f in _RESULT.split(", ")])

    return run


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
                prior: float = PRIOR, merge: float = MERGE) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score (the model).  ``held_out``: a boolean column
    expression over ``docs``; null counts as held out."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                       F.col(id_col).isNull().alias("no_id"),
                       F.coalesce(held_out, F.lit(True)).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    size = C.text_bytes(base)
    shards = C.bucket_count(size, LEAST_SHARDS)
    often = max(1, size // FREQUENT)
    counts = (base.filter("NOT held_out").select("doc_id", "text").mapInArrow(_word_counts, "word long, n long")
              .groupBy("word").agg(F.sum("n").alias("n")))
    # the list has at most FREQUENT words and the end: each occurrence takes a byte of text
    row = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"),
                     F.collect_list(F.when((F.col("n") >= often) | (F.col("word") == int(_END.view(np.int64))),
                                           F.struct("word", "n"))).alias("often")).first()
    total, distinct = row["total"] or 0, row["distinct"]
    pairs = sorted((np.int64(w).view(np.uint64), n) for w, n in row["often"])
    frequent = np.asarray([w for w, _ in pairs], np.uint64)
    frequent_n = np.asarray([n for _, n in pairs], np.int64)
    texts = int(frequent_n[frequent == _END].sum())
    asked = base.mapInArrow(_requests(shards, frequent), _REQUEST)
    answers = asked.groupBy("shard").applyInArrow(
        _shard(total, distinct, frequent, frequent_n, prior, merge), _ANSWER)
    return answers.groupBy("block").applyInArrow(_finish(total, distinct, texts, prior, merge), _RESULT)
