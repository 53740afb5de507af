"""rivulet: incremental and change-data processing as pure DataFrame transformations."""
