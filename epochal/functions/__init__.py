"""Values and the expression compiler."""
