"""The bilingual query language: lexer, syntax tree, parser, diagnostics."""
