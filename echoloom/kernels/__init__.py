"""NumPy kernels for Arrow workers: published signal-processing algorithms, batched over rows where it pays."""
