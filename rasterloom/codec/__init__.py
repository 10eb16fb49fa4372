"""The blob format in numpy, without Spark: one blob in, one raster out, and back."""
