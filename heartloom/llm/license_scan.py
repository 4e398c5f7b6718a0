"""Licence detection by diagonal voting.

Rolling word k-grams of every text are hashed and joined to the positions of licence templates. Hits of a template with
one offset (document position less template position) lie on one diagonal. Neighbouring diagonals are merged in
windows that overlap by half, each no wider than twice the template's drift, so small insertions and deletions don't
break a span and no chain of diagonals grows without end. A merged span is verified: the longest run of its hits that
keeps the template's order within the drift must hold the telling words (name and version), those that are neighbours
in the template as neighbours, and enough of the grams.
Grams of common words alone don't vote for notices, or nearly every text would be a candidate.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom.llm.common import cut

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Licence notices and whole short licences that are searched for, their labels, and the words that tell one from
#: another and must all be there. Public texts. Fixed values.
NOTICES = (
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "software documentation"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit", "sublicense",
    ),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc", "fee"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license 2 0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0", "required writing basis"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0", "required writing basis"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", "gnu general public license 3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", "gnu general public license 2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu general public license"),
    ("licensed under the gnu lesser general public license", "lgpl", "lesser public license"),
    ("licensed under the gnu affero general public license", "agpl", "affero public license"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4 0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", "creative commons attribution 4 0"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd", "binary disclaimer",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "binary modification"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla public license 2 0"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", "unencumbered"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", "authors liable"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0", "cc by nd 4 0"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0", "creative commons attribution sharealike 4 0"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0", "creative commons attribution noncommercial 4 0"),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "cc-by-nd-4.0", "creative commons attribution noderivatives 4 0"),
    ("distributed under the creative commons cc0 1 0 universal public domain dedication", "cc0-1.0", "cc0 1 0 universal"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause", "endorse promote"),
    ("bsd 3 clause license", "bsd-3-clause", "bsd 3 clause"),
    ("bsd 2 clause license", "bsd-2-clause", "bsd 2 clause"),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", "apache-2.0", "contributor derivative"),
    ("you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions", "apache-2.0", "thereof derivative"),
    ("the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users", "gpl", "gnu guarantee freedom"),
    ("you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty", "gpl-2.0", "verbatim conspicuously disclaimer"),
    ("the gnu general public license is a free copyleft license for software and other kinds of works", "gpl-3.0", "gnu general copyleft"),
    ("you may convey verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice", "gpl-3.0", "convey verbatim"),
    ("this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and of other authors who decide to use it", "lgpl", "lesser libraries"),
    ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below", "lgpl", "lesser incorporates"),
    ("if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version", "agpl", "remotely network"),
    ("each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights other than patent or trademark licensable by such contributor to use reproduce make available modify display perform distribute and otherwise exploit its contributions", "mpl-2.0", "licensable exploit"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", "eclipse public license"),
    ("the accompanying program is provided under the terms of this eclipse public license any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", "epl", "eclipse recipient"),
    *((f"spdx license identifier {words}", label, f"identifier {words}") for label, words in (
        ("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
        ("mpl-2.0", "mpl 2 0"), ("epl", "epl 2 0"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("cc0-1.0", "cc0 1 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("bsl-1.0", "bsl 1 0"),
    )),
)
#: Words too common to vote alone. Fixed values.
COMMON = frozenset("a all an and any are as at be by for from in is it of on or that the this to under use with without you".split())


@dataclass(frozen=True)
class ScanParams:
    """k: words of a gram; drift: diagonals that merge, and one more for each ``slack`` grams of a long template;
    cover: share of a template's voting grams that a span must hold in order."""

    k: int = 2
    drift: int = 2
    slack: int = 10
    cover: float = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[str, ...]
    votes: tuple[int, ...]
    telling: tuple[int, ...]
    whole: tuple[int, ...]
    drift: int
    need: int


@lru_cache(8)
def templates(p: ScanParams) -> tuple[Template, ...]:
    """The base phrases, which must be held whole on one diagonal, and the notices."""
    out = []
    for text, label in PHRASES:
        ws = tuple(text.split())
        n = len(ws) - p.k + 1
        out.append(Template(label, True, ws, tuple(range(n)), tuple(range(len(ws))), tuple(range(n)), 0, n))
    for text, label, telling in NOTICES:
        ws = tuple(text.split())
        votes = tuple(t for t in range(len(ws) - p.k + 1) if not COMMON.issuperset(ws[t : t + p.k]))
        tells = tuple(i for i, w in enumerate(ws) if w in telling.split())
        # a word that is repeated in a long template tells once
        tells = tells if len(tells) == len(telling.split()) else tuple(ws.index(w) for w in telling.split())
        whole = tuple(t for t in tells if t + 1 in tells and t in votes)
        out.append(Template(label, False, ws, votes, tells, whole, p.drift + len(votes) // p.slack, -(-int(100 * p.cover) * len(votes) // 100)))
    return tuple(out)


def _grams(spark: SparkSession, p: ScanParams) -> DataFrame:
    """(template, base, t, gram, h, drift, need): each template's voting k-grams by position. Fixed, some hundred rows."""
    rows = [(i, x.base, t, " ".join(x.words[t : t + p.k]), max(x.drift, 1), x.need) for i, x in enumerate(templates(p)) for t in x.votes]
    return spark.createDataFrame(rows, "template int, base boolean, t int, gram string, drift int, need int").withColumn("h", F.xxhash64("gram"))


#: What tells a row from others: id, length and hash of the text. Only rows of one id, length and hash can be taken for
#: one another, and they would have to be different texts.
ROW = ("doc_id", "chars", "hash")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("chars"), F.xxhash64(text).alias("hash"))


def votes(held: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """ROW and (template, base, t, drift, need, pos) of every k-gram of every text that a template holds.

    Grams are exploded and dropped in one pass; only hits leave it.
    """
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = F.filter(F.split(text, WORD_BREAK), lambda x: x != "")
    held = held.select(*ROW, ws.alias("ws")).filter(F.size("ws") >= p.k)
    grams = F.transform(F.sequence(F.lit(0), F.size("ws") - p.k), lambda i: F.concat_ws(" ", *(F.get("ws", i + j) for j in range(p.k))))
    each = held.select(*ROW, F.posexplode(grams).alias("pos", "word")).withColumn("h2", F.xxhash64("word"))
    # the hash finds, the gram itself decides
    hits = each.join(F.broadcast(_grams(held.sparkSession, p)), (F.col("h2") == F.col("h")) & (F.col("word") == F.col("gram")))
    return hits.select(*ROW, "template", "base", "t", "drift", "need", F.col("pos").cast("long").alias("pos"))


def longest(hits: list[tuple[int, int]], drift: int) -> list[tuple[int, int]]:
    """The most hits (pos, t) with rising positions and rising template positions whose diagonals lie within drift."""
    best: list[tuple[int, int]] = []
    for low in sorted({pos - t for pos, t in hits}):
        some = sorted({(pos, -t) for pos, t in hits if low <= pos - t <= low + drift})
        if len(some) <= len(best):
            continue
        ends: list[int] = []  # smallest last t of a run of each length
        at, back = [], []
        for k, (_, minus) in enumerate(some):
            i = bisect_left(ends, -minus)
            ends[i : i + 1] = [-minus]
            at[i : i + 1] = [k]
            back.append(at[i - 1] if i else -1)
        if len(ends) > len(best):
            k, run = at[-1], []
            while k >= 0:
                run.append((some[k][0], -some[k][1]))
                k = back[k]
            best = run[::-1]
    return best


def verified(hits: list[tuple[int, int]], x: Template, k: int) -> tuple[int, float] | None:
    """Where the span begins and the share of its template's votes that it holds in order; None if it is too little."""
    run = longest(hits, x.drift)
    seen = {t + j for _, t in run for j in range(k)}
    if len(run) < x.need or not seen.issuperset(x.telling) or not {t for _, t in run}.issuperset(x.whole):
        return None
    return run[0][0], len(run) / len(x.votes)


def spans(hits: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """ROW and (template, first, score): verified spans. A base phrase has one row per place.

    A group is one template in one window of diagonals of one text, so it holds at most 4 * drift hits of each of the
    template's grams, whatever the text.
    """
    base = hits.filter("base").groupBy(*ROW, "template", (F.col("pos") - F.col("t")).alias("first")).agg(F.count_distinct("t").alias("n"), F.first("need").alias("need"))
    base = base.filter("n = need").select(*ROW, "template", "first", F.lit(1.0).alias("score"))
    window = F.floor((F.col("pos") - F.col("t")) / F.col("drift"))
    lines = hits.filter("not base").withColumn("w", F.explode(F.array(window - 1, window)))
    merged = lines.groupBy(*ROW, "template", "w").agg(F.collect_set(F.struct("pos", "t")).alias("hits"), F.first("need").alias("need")).filter(F.size(F.array_distinct("hits.t")) >= F.col("need"))
    merged = merged.select(*ROW, "template", "hits.pos", "hits.t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates(p)
        for batch in batches:
            cols = batch.to_pydict()
            found = [verified(list(zip(pos, t, strict=True)), known[i], p.k) for i, pos, t in zip(cols["template"], cols["pos"], cols["t"], strict=True)]
            kept = batch.select([*ROW, "template"]).filter(pa.array([x is not None for x in found], pa.bool_()))
            some = [x for x in found if x]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.float64())], [*ROW, "template", "first", "score"])

    return base.unionAll(merged.mapInArrow(run, "doc_id long, chars int, hash long, template int, first long, score double"))


def scan(docs: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and the score 0; very long texts are scanned whole. Score is the best
    share of a notice's grams that a span holds, 0 where only phrases are found; ties are of no account. Repeated rows get equal results; null
    doc_ids are no obstacle; extra columns are ignored, whatever their names; an empty table gives an empty table.
    """
    known = templates(p)
    names = F.broadcast(docs.sparkSession.createDataFrame([(i, x.label, x.base) for i, x in enumerate(known)], "template int, label string, base boolean"))
    held = keyed(docs)
    # hits are read twice, for phrases and for notices; texts only once
    found = cut(spans(cut(votes(held, p)), p)).join(names, "template")
    base = F.col("base")
    got = found.groupBy(*ROW).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(~base, F.col("score"))).alias("score"),
    )
    words = held.select(*ROW, F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    g = got.select(*(F.col(c).alias(f"g_{c}") for c in ROW), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    out = words.join(g, F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & (F.col("chars") == F.col("g_chars")) & (F.col("hash") == F.col("g_hash")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
