"""lattica: voxel-volume analytics expressed as Spark DataFrame transformations."""
