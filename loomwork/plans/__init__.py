"""Queries by family; REGISTRIES lists them all."""

from loomwork.plans import candidates, evaluation, exchange, links, markup, paging, parsing, publishing, relational, rules, search, sequences, streams, telemetry, texts

REGISTRIES = [links.R, relational.R, texts.R, publishing.R, telemetry.R, sequences.R, parsing.R, streams.R, evaluation.R, candidates.R, exchange.R, rules.R, paging.R, search.R, markup.R]
