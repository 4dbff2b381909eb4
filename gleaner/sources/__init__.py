"""Readers and writers of the corpus, vector, run and judgement formats."""
