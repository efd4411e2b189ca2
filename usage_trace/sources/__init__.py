"""Reading hits, source trees and result files; writing result files."""
