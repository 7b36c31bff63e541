"""Readers for the landed input files: SQL dump files for pages and
redirects, the article corpus, and the language metadata CSV."""
