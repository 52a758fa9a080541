"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trendgap.llm.common import read, shared_folder, stored
from trendgap.llm.debruijn import remove_repeated_spans
from trendgap.llm.decontamination import contaminated
from trendgap.llm.fill_middle import fill_in_middle, restored
from trendgap.llm.language import identify, learn
from trendgap.llm.licenses import license_scan
from trendgap.llm.merkle import merkle_fingerprints
from trendgap.llm.prefix_trie import prefix_trie, rebuilt, sequences
from trendgap.llm.quality import learn as learn_quality, score
from trendgap.llm.segmentation import sample_segmentations
from trendgap.llm.simhash import near_duplicates
from trendgap.llm.suffixes import remove_repeats
from trendgap.llm.token_counts import token_counts
from trendgap.llm.token_files import read_token_files, write_token_files


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return identify(documents, learn(documents))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score(documents, learn_quality(documents, read(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(read(spark, sf_dir, "documents"), model)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    folder = shared_folder(spark, "token-ids")
    documents = read(spark, sf_dir, "documents")
    files = stored(write_token_files(documents, model, folder), "token-files")
    return read_token_files(files, folder)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op7_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sample_segmentations(read(spark, sf_dir, "documents"), model)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fingerprints(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return prefix_trie(rebuilt(sequences(conversations))).drop("turn_id")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_license_scan": op6_license_scan,
    "op7_segmentation": op7_segmentation,
    "op8_simhash": op8_simhash,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_merkle": op10_merkle,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_middle": op12_fill_middle,
    "op13_substring_dedup": op13_substring_dedup,
}

# Lines, draws and digests of the fill-in-middle texts.
FILL_MIDDLE_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
    FROM documents
), draws AS (
    SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS one,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS suffix_first,
           t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
    FROM texts
), parts AS (
    SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[1:least(one, two)], '') AS p,
           array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS m,
           array_to_string(units[greatest(one, two) + 1:], '') AS s
    FROM draws
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

# Windows of 13 words, the smallest document of each, and the words that are left.
SUBSTRING_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT row, doc_id, place, array_to_string(words[place:place + 12], ' ') AS window_words
    FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM texts)
), smallest AS (
    SELECT window_words, min(doc_id) AS source FROM windows GROUP BY window_words
), gone AS (
    SELECT DISTINCT row, place + step AS place
    FROM (SELECT row, place, unnest(range(13)) AS step
          FROM windows JOIN smallest USING (window_words) WHERE doc_id > source)
), single AS (
    SELECT row, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM texts
), kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY place) AS words, count(*) AS n
    FROM single ANTI JOIN gone USING (row, place) GROUP BY row
)
SELECT doc_id, CAST(len(t.words) AS BIGINT) AS n_words,
       CAST(len(t.words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (row)
"""

# All prefixes of all rebuilt conversations, grouped; subtrees by pairing each node of a
# conversation with those below it. The CRC-32 of an id is worked out bit by bit.
PREFIX_TRIE_SQL = r"""
WITH turns AS (
    SELECT conv_id, length(coalesce(text, '')) AS chars, turn,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, name || ':' || chars AS name, chars,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, chars) AS place
    FROM turns
), ids AS (
    SELECT conv_id, conv_id - conv_id % 100 AS first, xor(list_reduce(
        [4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT),
        lambda crc, byte: list_reduce(
            [xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
            lambda value, step: xor(value >> 1, 3988292384 * (value & 1))
        )
    ), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM own)
), joined AS (
    SELECT ids.conv_id, 0 AS part, place, name, chars FROM ids JOIN own ON own.conv_id = first WHERE place <= h
    UNION ALL
    SELECT ids.conv_id, 1, place, name, chars FROM ids JOIN own ON own.conv_id = ids.conv_id WHERE place > h
), prefixes AS (
    SELECT conv_id, row_number() OVER turns_before AS depth, chars,
           md5(string_agg(name, ',') OVER turns_before) AS node
    FROM joined WINDOW turns_before AS (PARTITION BY conv_id ORDER BY part, place)
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM ids
), ends AS (
    SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest
    FROM (SELECT conv_id, max_by(node, depth) AS node FROM prefixes GROUP BY conv_id) GROUP BY node
), nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars
    FROM prefixes GROUP BY node, depth
), parents AS (
    SELECT DISTINCT below.node, above.node AS parent
    FROM prefixes below JOIN prefixes above ON above.conv_id = below.conv_id AND above.depth = below.depth - 1
), children AS (
    SELECT parent, count(*) AS n FROM parents GROUP BY parent
), subtrees AS (
    SELECT top, sum(CAST(n IS NULL AS BIGINT)) AS n_leaves, sum((n_convs - 1) * chars) AS saved
    FROM (SELECT DISTINCT above.node AS top, below.node
          FROM prefixes above JOIN prefixes below
            ON above.conv_id = below.conv_id AND above.depth <= below.depth)
    JOIN nodes USING (node) LEFT JOIN children ON children.parent = node
    GROUP BY top
)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs,
       coalesce(children.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes
LEFT JOIN parents USING (node) LEFT JOIN nodes up ON up.node = parents.parent
LEFT JOIN children ON children.parent = nodes.node
JOIN subtrees ON top = nodes.node LEFT JOIN ends ON ends.node = nodes.node
"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": PREFIX_TRIE_SQL,
    "op12_fill_middle": FILL_MIDDLE_SQL,
    "op13_substring_dedup": SUBSTRING_SQL,
}
