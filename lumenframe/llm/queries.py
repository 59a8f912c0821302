"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import chat, collocation, fingerprint, hmm, langid, lines, manifest, mixing, neardup, packing, pieces, topk, warc
from lumenframe.llm.common import ORACLE, QUERIES, fold, query, table
from lumenframe.session import settle, shared_folder

__all__ = ["ORACLE", "QUERIES"]


@query("op1_source_mixing")
def op1_source_mixing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.mix(docs, F.array("source"), mixing.count_words(F.col("text")))
    rows = mix.rows.withColumn("source", F.col("members")[0])
    sources = F.broadcast(mix.source_table().withColumnRenamed("source", "name"))
    return rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


@query(
    "op2_warc_chunks",
    """
    with p as (
        select page_id, coalesce(html, '') as body, url from pages
    ), d as (
        select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from p
    ), f as (
        select *, min(page_id) over (partition by payload_digest) as first_id from d
    )
    select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
           case when payload_bytes >= 100 and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 100 and page_id is distinct from first_id then first_id end as refers_to
    from f
    """,
)
def op2_warc_chunks(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = warc.mark_revisits(pages, "page_id", F.col("html"), F.col("url"))
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    files = settle(warc.write_archives(warc.chunk_payloads(records), folder))
    return warc.summarize(warc.read_archives(files.repartition(max(1, files.count()), "file")))


@query("op4_language_id")
def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("fold", fold("doc_id", 4))
    model = langid.train(docs.where("fold <> 2"), F.col("text"), F.col("lang"))
    held_out = F.coalesce(F.col("fold") == 2, F.lit(False))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = settle(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.place(pieces).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


@query(
    "op3_pivot_top_k",
    """
    with v as (
        select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
        select q.vec_id as query_id, c.vec_id,
               cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
    ), r as (
        select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
    )
    select query_id, rank, vec_id, score from r where rank <= 5
    """,
)
def op3_pivot_top_k(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vector = F.when(topk.valid(F.col("embedding")), topk.scaled(F.col("embedding")))
    return topk.top_k(rows, "vec_id", vector, F.col("vec_id") % 50 == 0)


@query("op7_bottom_k_fingerprints")
def op7_bottom_k_fingerprints(spark, sf_dir) -> DataFrame:
    prints = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    rows = fingerprint.with_next(prints, "doc_id", ["text", "sketch"])
    rows = rows.withColumn("edited", fingerprint.spliced(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", fingerprint.sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.to_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@query(
    "op8_perspective_rotation",
    """
    with t as (
        select conv_id, cast(floor(turn / 256) as bigint) as part, turn,
               replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(13), ' '), chr(10), ' ') as speaker,
               replace(coalesce(text, ''), '<|', '< |') as body
        from conversations
    ), p as (
        select distinct conv_id, speaker as perspective from t where speaker <> 'system'
    ), r as (
        select t.*, perspective, speaker = perspective as own,
               '<|im_start|>' || case when speaker = perspective then 'assistant' when speaker = 'system' then 'system'
                                      else 'user name=' || speaker end || chr(10) as head
        from t join p on t.conv_id is not distinct from p.conv_id
    ), s as (
        select *, cast(sum(length(head) + length(body) + 11) over (
                   partition by conv_id, part, perspective order by turn nulls first, speaker, body rows unbounded preceding
               ) as bigint) - length(body) - 11 as start
        from r
    )
    select conv_id, part, perspective, count(*) as n_turns,
           string_agg(head || body || '<|im_end|>' || chr(10), '' order by turn nulls first, speaker, body) as rendered,
           coalesce(string_agg(case when own then start || '-' || (start + length(body) + 10) end, ','
                    order by turn nulls first, speaker, body), '') as target_spans
    from s group by conv_id, part, perspective
    """,
)
def op8_perspective_rotation(spark, sf_dir) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("targets", lambda t: F.concat(t["start"].cast("string"), F.lit("-"), t["end"].cast("string")))
    return views.withColumn("target_spans", F.array_join(spans, ",")).drop("targets")


@query("op10_hidden_markov_scores")
def op10_hidden_markov_scores(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = fold("doc_id", 7)
    counted = hmm.count_words(settle(hmm.blocks(docs, "doc_id", F.col("text"), rest != 2, rest == 2)))
    return hmm.score(counted, hmm.train(counted))


@query("op9_tensored_minhash")
def op9_tensored_minhash(spark, sf_dir) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query(
    "op6_line_templates",
    """
    with rows as (
        select distinct doc_id, text from documents where text is not null
    ), split as (
        select doc_id, text, string_split(text, chr(10)) as lines from rows
    ), each as (
        select doc_id, text, i as pos, list_filter(regexp_split_to_array(lines[i + 1], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as plain
        from (select *, unnest(range(len(lines))) as i from split)
    ), masked as (
        select doc_id, text, pos, len(plain) as n, plain,
               case when len(plain) < 4 then plain
                    else list_transform(plain, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) end as words
        from each where len(plain) >= 1
    ), thin as (
        select doc_id, text, pos, n, words, n || ' ' || array_to_string(words[1:3], ' ') as leaf, array_to_string(words, ' ') as content,
               case when n >= 50 then array_to_string(plain, ' ') end as own
        from masked
    ), by_line as (
        select leaf, content, any_value(n) as n, any_value(words) as words, count(distinct (doc_id, text)) as docs from thin group by leaf, content
    ), varied as (
        select leaf from by_line where docs < 3 group by leaf having sum(docs) >= 3
    ), placed as (
        select leaf, content, n, docs, i as place, words[i] as word
        from (select *, unnest(range(1, n + 1)) as i from by_line where leaf in (from varied))
    ), support as (
        select leaf, place, word from placed where word <> '<*>' group by all having sum(docs) >= 3
    ), general as (
        select p.leaf, p.content, any_value(p.n) as n, any_value(p.docs) as docs, count(s.word) as constants,
               string_agg(coalesce(s.word, '<*>'), ' ' order by p.place) as template
        from placed p left join support s using (leaf, place, word) group by p.leaf, p.content
    ), templates as (
        select leaf, content, 'line ' || content as template from by_line where docs >= 3
        union all
        select leaf, content, 'general ' || leaf || ' ' || template from general where docs < 3 and constants >= 0.8 * n
    ), pairs as (
        select leaf, own from thin where own is not null group by leaf, own having count(distinct (doc_id, text)) = 2
    ), occurring as (
        select template, doc_id, text, pos, 3 as needed from thin join templates using (leaf, content)
        union all
        select 'long ' || own, doc_id, text, pos, 2 from thin join pairs using (leaf, own)
    ), recurring as (
        select template from occurring group by template, needed having count(distinct (doc_id, text)) >= needed
    ), numbered as (
        select *, row_number() over (partition by template order by doc_id nulls last, pos) as nth from occurring where template in (from recurring)
    ), drops as (
        select doc_id, text, list(distinct pos) as drops from numbered where nth > 1 group by doc_id, text
    )
    select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) as n_lines,
           cast(coalesce(len(drops), 0) as bigint) as n_dropped,
           case when drops is null then d.text else coalesce(array_to_string(
               list_filter(string_split(d.text, chr(10)), lambda x, i: not list_contains(drops, i - 1)), chr(10)), '') end as text
    from documents d left join drops x on d.doc_id is not distinct from x.doc_id and d.text = x.text
    """,
)
def op6_line_templates(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_recurring_lines(docs)


@query("op11_merkle_manifest")
def op11_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = manifest.leaf([F.col(c) for c in manifest.FIELDS])
    presented = F.when(fold("doc_id", 3) == 0, manifest.lowered()).otherwise(own)
    rows = manifest.manifest(docs, presented=presented)
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


@query("op12_piece_codec")
def op12_piece_codec(spark, sf_dir) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = pieces.decode(encoded, model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op13_suffix_collocations",
    """
    with piece as (
        select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
        from documents
    ), split as (
        select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from piece
    ), suffix as (
        select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3 from (select lang, w, unnest(range(1, len(w) + 1)) as i from split)
    ), f1 as (
        select lang, w1, cast(count(*) as hugeint) as f from suffix group by all
    ), f2 as (
        select lang, w1, w2, cast(count(*) as hugeint) as f from suffix where w2 is not null group by all
    ), f3 as (
        select lang, w1, w2, w3, cast(count(*) as hugeint) as f from suffix where w3 is not null group by all having count(*) >= 10
    ), inside as (
        select lang, w1, w2, max(f) as most from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all
    ), short as (
        select p.lang, p.w1 || ' ' || p.w2 as phrase, p.f as a, x.f as l, y.f as r, 1000000 * p.f * p.f // (x.f * y.f) as score
        from f2 p join f1 x on x.lang = p.lang and x.w1 = p.w1 join f1 y on y.lang = p.lang and y.w1 = p.w2
        left join inside i on i.lang = p.lang and i.w1 = p.w1 and i.w2 = p.w2
        where p.f >= 10 and (most is null or 100 * most < 50 * p.f)
    ), cuts as (
        select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 as phrase, t.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2,
               1000000 * t.f * t.f // (x.f * yz.f) as s1, 1000000 * t.f * t.f // (xy.f * z.f) as s2
        from f3 t join f1 x on x.lang = t.lang and x.w1 = t.w1 join f2 yz on yz.lang = t.lang and yz.w1 = t.w2 and yz.w2 = t.w3
        join f2 xy on xy.lang = t.lang and xy.w1 = t.w1 and xy.w2 = t.w2 join f1 z on z.lang = t.lang and z.w1 = t.w3
    ), scored as (
        select * from short
        union all
        select lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) from cuts
    ), ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored
    ), sizes as (
        select lang, sum(f) as n from f1 group by lang
    )
    select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n,
           cast(score as bigint) as score
    from ranked join sizes using (lang) where rank <= 2000
    """,
)
def op13_suffix_collocations(spark, sf_dir) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))
