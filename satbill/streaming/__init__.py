"""File streams over the batch functions."""
