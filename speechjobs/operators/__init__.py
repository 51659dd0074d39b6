"""Table operators: lexicon, ingest, totals, regions, history, evaluation, frames, cohorts."""
