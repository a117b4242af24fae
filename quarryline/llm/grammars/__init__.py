"""Parsing-expression grammars of the languages whose files are checked."""
