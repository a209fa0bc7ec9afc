"""Source files to facts: symbols, imports, calls and references, one adapter a language."""
