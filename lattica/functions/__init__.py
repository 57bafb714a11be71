"""Part of lattica; see the README for what each module holds."""
