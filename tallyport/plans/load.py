"""Imports every module that registers views or operators."""

from tallyport.operators import chunks, derivatives, hashing, images, intervals, receipts, records, resume, sessions, validation  # noqa: F401
from tallyport.plans import views  # noqa: F401
from tallyport.sources import files  # noqa: F401
