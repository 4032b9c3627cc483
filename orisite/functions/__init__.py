"""Column-expression helpers: 3-vector algebra and fixed-width record fields."""
