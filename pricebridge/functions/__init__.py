"""Column functions: text hygiene, strengths, forms, packs, price qualifiers, molecules, names, keys, similarity."""
