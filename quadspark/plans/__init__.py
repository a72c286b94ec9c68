"""Front ends and logical plans."""
