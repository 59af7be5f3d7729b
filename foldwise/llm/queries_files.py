"""Queries over token files, conversation tries and the vocabulary."""

from __future__ import annotations

from foldwise.llm import prefix_trie, spelling, token_files
from foldwise.llm.registry import query, table
from foldwise.session import shared_folder


@query("op11_token_files")
def op11(spark, sf_dir):
    import public_tokenizers

    root = shared_folder(spark, "tokens")
    token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), root)
    return token_files.read_files(spark, root)


@query("op12_prefix_trie", prefix_trie.oracle())
def op12(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_spelling_variants", spelling.oracle())
def op13(spark, sf_dir):
    return spelling.group_variants(spelling.vocabulary(table(spark, sf_dir, "documents")))
