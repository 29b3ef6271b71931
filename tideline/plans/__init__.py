"""From query text to DataFrame plans: syntax tree, parser, checks, compiler."""
